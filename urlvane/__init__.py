"""URL-threat analytics over navigation tables and streams, as PySpark jobs."""
