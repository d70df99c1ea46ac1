"""The query language: text to tokens, to a syntax tree, to DataFrames."""
