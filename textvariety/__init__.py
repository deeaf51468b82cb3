"""Spark-native engine for text-variety corpora, classifiers and reports.

Every function takes and returns DataFrames or Columns; none creates a
session. See README.md for the map of modules.
"""
