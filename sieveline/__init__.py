"""Sieveline: quality-aware retrieval analytics as Spark DataFrame transformations."""
