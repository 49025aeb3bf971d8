"""Code-inefficiency audit over tables of source files, built on Spark DataFrames."""
