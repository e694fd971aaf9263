"""Analytics over ensembles of categorical observations, on Spark.

A frame is one observation: sample_id, frame_id and an array of labels, one per site (null: unassigned). Keeping a
frame's labels in one row makes per-frame work (filters, pairs of sites, energies) free of shuffles; counts are
pre-aggregated before they are exchanged.
"""
