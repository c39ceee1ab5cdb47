"""Risk-scoring analytics on Spark: profiling, splitting, binning, encoding, selection, scoring and drift."""
