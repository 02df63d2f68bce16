"""Pattern queries over knowledge hypergraphs, compiled to Spark DataFrames."""
