"""quarrylake: set-at-a-time retrieval analytics on Spark DataFrames."""
