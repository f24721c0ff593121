"""Column expressions. Everything here maps Columns to Columns."""
