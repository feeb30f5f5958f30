"""Column functions: text, numbers, exact statistics."""
