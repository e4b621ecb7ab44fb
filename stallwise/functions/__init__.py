"""Column functions and shared building blocks."""
