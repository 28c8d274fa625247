"""Media catalogs and similarity analytics on Spark DataFrames."""
