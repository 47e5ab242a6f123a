"""sievework: a Spark-first engine for screening, scoring and cleaning text records at scale."""
