"""logsift: a log search engine built on Spark DataFrames."""
