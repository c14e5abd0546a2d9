"""Time-series data engine on Spark: every operator takes and returns DataFrames."""
