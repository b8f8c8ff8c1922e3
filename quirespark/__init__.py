"""Document structuring and corpus preparation as Spark DataFrame plans."""
