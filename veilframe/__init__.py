"""veilframe: sensitive-data detection, policy and masking as Spark DataFrame jobs."""
