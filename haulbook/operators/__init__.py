"""Relational building blocks, each a pure function of DataFrames."""
