"""Column expressions: quantisers, distances, bit-packed keys, transaction features, the score law."""
