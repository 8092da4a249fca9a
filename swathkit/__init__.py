"""Space-time colocation and text-corpus operators as Spark DataFrame jobs."""
