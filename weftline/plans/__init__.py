"""Composed workflows."""
