"""sketchmill: diagram-corpus curation and analytics on Spark DataFrames."""
