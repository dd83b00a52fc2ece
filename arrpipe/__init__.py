"""Company-revenue observations from news articles, as Spark DataFrame jobs."""
