"""mediaspark: media-metadata analytics as Spark DataFrame jobs."""
