"""palisade: security-event analytics as Spark DataFrame jobs."""
