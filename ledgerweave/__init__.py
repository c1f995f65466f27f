"""Settlement reconciliation as Spark DataFrame jobs."""
