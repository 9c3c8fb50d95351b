"""Column-level rules: every function takes and returns Columns."""
