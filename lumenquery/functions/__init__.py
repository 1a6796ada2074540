"""Column expressions: spatial, text and vector arithmetic."""
