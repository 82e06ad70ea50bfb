"""Metrics of eigenpairs and embeddings."""
