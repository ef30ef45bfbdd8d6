"""Pipelines over streams: the narrow operators of a lineage apply to a streaming DataFrame unchanged.

See :func:`rillwork.streaming.narrow.apply_narrow`.
"""
