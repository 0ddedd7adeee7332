"""Analytics for metered energy series, written as Spark DataFrame jobs."""
