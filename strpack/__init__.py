"""strpack: dictionary compression of short-string columns with random access, on Spark DataFrames."""
