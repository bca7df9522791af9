"""Vicinity: batch hybrid (attribute-filtered) vector search on Spark."""
