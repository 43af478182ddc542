"""Catalog operators: DataFrame in, DataFrame out."""
