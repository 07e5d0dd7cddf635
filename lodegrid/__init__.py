"""Grid-based prospectivity analytics as lazy PySpark DataFrame operators."""
