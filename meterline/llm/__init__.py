"""Training-data operators (numbered contracts) built on Spark DataFrames."""
