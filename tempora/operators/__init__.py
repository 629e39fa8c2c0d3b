"""Evaluation operators (DataFrame in, DataFrame out)."""
