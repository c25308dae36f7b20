"""Predicates over nodes and their attributes, compiled to joins."""
