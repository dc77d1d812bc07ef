"""pagegraph: page lists and wiki change tables as typed graphs, on Spark DataFrames."""
