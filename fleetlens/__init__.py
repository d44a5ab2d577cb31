"""Vehicle quality analytics as PySpark DataFrame operators."""
