"""Document analytics on Spark: chunking, search, rule evaluation and arbitration as DataFrame plans."""
