"""Detection, stable pseudonyms, rewriting and leak checks of text, as Spark DataFrames."""
