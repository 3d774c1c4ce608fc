"""Controlled rewriting and frequency analytics of text corpora on Spark DataFrames."""
