"""Document-corpus analytics on Spark: every operator is DataFrame(s) -> DataFrame."""
