"""Operators over DataFrames: shaping, metrics, ensembles, trees."""
