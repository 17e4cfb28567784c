"""Column functions: markup, words and similarity arithmetic."""
