"""Financial-filings analytics and training-data preparation on Spark."""
