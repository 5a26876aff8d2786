"""Learning-corpus analytics as Spark DataFrame jobs."""
