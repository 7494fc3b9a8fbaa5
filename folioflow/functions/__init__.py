"""Column expressions: text metrics, ids, paths, messages."""
