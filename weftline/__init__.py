"""weftline: sequence-overlap analytics on Spark DataFrames."""
