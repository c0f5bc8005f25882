"""Column functions: text, JSON text, timestamps and small rules."""
