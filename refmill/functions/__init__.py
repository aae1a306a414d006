"""Column expressions: text folding, similarity, citation keys, bibliography fields."""
