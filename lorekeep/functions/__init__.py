"""Column functions: text, dates, vectors and keys."""
