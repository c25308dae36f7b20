"""nodeloom: knowledge-graph analytics expressed as PySpark DataFrame plans."""
