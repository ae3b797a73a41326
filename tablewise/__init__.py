"""Review analytics, recommendations and review/event streams on Spark DataFrames."""
