"""Column functions: special functions and densities."""
