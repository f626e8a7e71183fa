"""Composed selection methods, registered queries and oracle SQL."""
