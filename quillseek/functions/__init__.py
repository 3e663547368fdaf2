"""Column functions and literal evaluation that expressions need."""
