"""Subgroup model evaluation on Spark.

Layers, from the bottom up:

``functions``  column expressions (rules, one-hot, order keys, rounding)
``sources``    reading cohort tables, storing and re-reading result tables
``operators``  DataFrame-in, DataFrame-out steps (split, impute, metrics, ...)
``plans``      whole flows built from operators (evaluation, reports, study)
``catalog``    registered queries on the star-schema tables and their SQL twins
"""

__version__ = "0.1.0"
