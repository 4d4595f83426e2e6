"""Panel time-series, news and forecast-evaluation operators on Spark DataFrames."""
