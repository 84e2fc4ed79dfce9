"""Refresh gating and lineage analytics over DataFrames."""
