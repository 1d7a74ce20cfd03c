"""Column expressions: calendar, numeric and text helpers."""
