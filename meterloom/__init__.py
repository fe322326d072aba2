"""Usage and trace analytics as PySpark DataFrame jobs."""
