"""touchline: match, event and player analytics on Spark DataFrames."""
