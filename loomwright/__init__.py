"""Script, prompt-list and media-pipeline analytics on Spark DataFrames."""
