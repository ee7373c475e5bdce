"""Set-oriented compatibility, pricing and catalog analytics on Spark DataFrames."""
