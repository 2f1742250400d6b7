"""Trace audit, ranking datasets and paired-experiment statistics on Spark."""
