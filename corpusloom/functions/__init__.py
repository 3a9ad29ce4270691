"""Column expressions: text analysis, similarity formulas, JSON, keys, vectors, geo."""
