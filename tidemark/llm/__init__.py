"""Operators of a training-data pipeline: reading, filtering, deduplicating, mixing, packing.

Nothing outside this subpackage imports it; ``tidemark.llm.queries`` registers its queries.
"""
