"""Column functions: text, commands and vectors."""
