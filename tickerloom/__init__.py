"""Market and news data on Spark: landing, cleaning, features, scoring and evaluation.

Every step is a function from DataFrames to a DataFrame.  Clocks, thresholds, rules
and watch-lists are parameters; the defaults are in :mod:`tickerloom.names`.
"""
