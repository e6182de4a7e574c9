"""Lowering of expressions and the query builder."""
