"""Tessera: filtered vector similarity search as Spark plans."""
