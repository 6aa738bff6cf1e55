"""Filings analytics on Spark: DataFrame operators over reports, facts and metrics of all issuers at once."""
