"""Relational operators: neighbours, fuzzy graphs, Laplacians, components, preparation, placement."""
