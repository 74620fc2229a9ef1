"""Searches, indexes and evaluation."""
