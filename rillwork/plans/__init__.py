"""Lineage, stage plans, job specifications and the compiler to DataFrames."""
