"""Column functions: signatures, text and JSON pieces."""
