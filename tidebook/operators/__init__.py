"""Operators on DataFrames: decoding, sequencing, books, comparison, histograms."""
