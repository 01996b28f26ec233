"""Document analytics and multi-label clause detection on PySpark DataFrames."""
