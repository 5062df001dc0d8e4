"""Column expressions: dates, text, patterns and row-wise values."""
