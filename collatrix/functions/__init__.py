"""Key expressions and small value helpers."""
