"""esig: epoched time-series analytics as Spark DataFrame operators."""
