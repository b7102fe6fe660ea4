"""Time-series and panel econometrics on Spark DataFrames."""
