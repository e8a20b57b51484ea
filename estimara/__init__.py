"""Statistics and econometrics on Spark DataFrames."""
