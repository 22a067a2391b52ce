"""Column expressions: everything here stays inside generated code."""
