"""Web-page extraction and run-history analytics as Spark DataFrame jobs."""
