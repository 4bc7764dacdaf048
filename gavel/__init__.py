"""Civic-records analytics on Spark: DataFrame jobs for meeting records and document collections."""
