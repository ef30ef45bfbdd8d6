"""Registered functions and the partitioner's hash."""
