"""Solvers, embedding plans and the registered queries."""
