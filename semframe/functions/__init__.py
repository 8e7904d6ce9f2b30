"""Column functions and driver-side mini-languages."""
