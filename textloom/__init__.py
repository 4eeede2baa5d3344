"""textloom: corpus preparation, text features and training-data operators on Spark DataFrames."""
