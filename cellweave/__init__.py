"""Analytics over partitioned N-dimensional arrays, expressed as Spark DataFrames."""
