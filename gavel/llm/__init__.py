"""Operators of a large-scale training-data pipeline (see the README section "llm")."""
