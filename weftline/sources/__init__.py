"""Readers, writers and the adapter over the shipped test tables."""
