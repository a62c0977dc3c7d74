"""lakeloom: content-analytics operators on PySpark DataFrames."""
