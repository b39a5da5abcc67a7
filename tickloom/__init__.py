"""tickloom: market-data analytics expressed as Spark DataFrame transforms."""
