"""galley: editorial and bibliographic analytics as PySpark DataFrame jobs."""
