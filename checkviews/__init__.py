"""Check queries: views over the given tables, operators on them, SQL equivalents."""
