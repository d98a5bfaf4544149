"""Multi-sensor track analytics, expressed as Spark DataFrame operators."""
