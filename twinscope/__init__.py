"""Copy detection over fingerprints as Spark DataFrames."""
