"""Column builders over vectors, ids and file names."""
