"""Trace, code-graph and evidence analytics expressed as Spark DataFrame plans."""
