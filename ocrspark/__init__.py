"""Corpus-scale analytics over recognised documents, on Spark DataFrames."""
