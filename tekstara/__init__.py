"""Text and lexicon analytics on Spark DataFrames."""
