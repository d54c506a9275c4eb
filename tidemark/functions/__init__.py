"""Column functions: keys, time, text, hashing."""
