"""Column helpers: windows and scalar functions."""
