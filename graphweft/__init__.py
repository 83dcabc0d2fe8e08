"""graphweft: SPARQL over graphs and series tables, planned as Spark DataFrames."""
