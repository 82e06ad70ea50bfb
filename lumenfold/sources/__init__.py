"""Readers, writers, reports and generators."""
