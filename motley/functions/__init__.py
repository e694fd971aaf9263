"""Column functions: scalar mathematics, geometry, strings and arrays."""
