"""Evidence analytics on Spark: corpora of technical documents as DataFrames."""
