"""Route analytics for network path measurements, as Spark DataFrame transforms."""
