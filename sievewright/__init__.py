"""Listing analytics on Spark: DataFrame jobs over listings, evidence, catalogue snapshots and web pages."""
