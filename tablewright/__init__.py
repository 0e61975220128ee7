"""Multiple-choice dataset analytics on Spark DataFrames."""
