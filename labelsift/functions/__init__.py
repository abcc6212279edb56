"""Column expressions: no actions, no joins, no Python workers."""
