"""Column expressions: coordinates, ids and text, vectors, and the few vectorised UDFs."""
