"""Column functions: reversible hashing and tile arithmetic."""
