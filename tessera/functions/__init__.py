"""Columns over vectors and geometry, and synthetic workloads."""
