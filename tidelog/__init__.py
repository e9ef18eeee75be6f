"""tidelog: partitioned, append-only log analytics on Spark DataFrames."""
