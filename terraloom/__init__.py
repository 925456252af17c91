"""Agricultural analytics and corpus preparation as PySpark jobs."""
