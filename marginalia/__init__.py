"""marginalia: batch evidence retrieval and corpus quality on PySpark DataFrames."""
