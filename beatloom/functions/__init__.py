"""Column functions: text, time codes, geometry, colour."""
