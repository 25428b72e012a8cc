"""tickerloom: market-data and signal analytics written as Spark DataFrame jobs."""
