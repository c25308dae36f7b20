"""Column functions: text, dates, formats."""
