"""Analytics over captured web pages and documents, as Spark DataFrames."""
