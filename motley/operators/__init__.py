"""Operators over frames of labels, distributions, models and chains."""
