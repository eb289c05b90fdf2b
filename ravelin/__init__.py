"""Code-graph analytics as Spark DataFrame plans."""
