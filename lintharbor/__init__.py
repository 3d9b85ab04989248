"""Application-security findings analytics, expressed as Spark DataFrame jobs."""
