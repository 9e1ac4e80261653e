"""Document and code knowledge-graph analytics expressed as Spark DataFrame plans."""
