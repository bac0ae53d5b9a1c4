"""Column functions: text, tiers, vectors, paths and hashes."""
