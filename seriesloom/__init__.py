"""Analytics for large panels of time series, written as Spark plans."""
