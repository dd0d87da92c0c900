"""wayfold: spatial-network analytics on PySpark DataFrames."""
