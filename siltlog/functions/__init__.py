"""Column expressions: key order, byte sizes, Bloom filter sizing."""
