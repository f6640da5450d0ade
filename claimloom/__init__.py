"""claimloom: evidence retrieval and claim verification on Spark DataFrames."""
