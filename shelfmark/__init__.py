"""Document-library analytics as DataFrame-to-DataFrame operators on PySpark."""
