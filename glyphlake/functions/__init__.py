"""Column functions: code points, display, vectors. All are built-in expressions."""
