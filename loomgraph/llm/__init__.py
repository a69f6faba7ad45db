"""Operators for large-scale training data: similarity, ranking, leakage, mixing and language identification."""
