"""Storage, search and consolidation of short text facts on Spark DataFrames."""
