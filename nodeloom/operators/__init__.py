"""Operators over a catalog: queries, aggregation, time, tables, graph, text, vectors, schema, incremental."""
