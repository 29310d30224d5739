"""Web-corpus quality and design-token analytics, expressed as Spark DataFrames."""
