"""Fairness operators: DataFrame in, DataFrame out."""
