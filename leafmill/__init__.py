"""leafmill: analytics operators written as PySpark DataFrame jobs."""
