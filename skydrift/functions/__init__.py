"""Column expressions: spherical geometry, counting statistics, hashing, bit masks."""
