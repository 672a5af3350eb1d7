"""Evidence analytics on Spark: DataFrame-to-DataFrame operators over Parquet."""
