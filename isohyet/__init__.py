"""Isohyet: gridded time-series analytics expressed as Spark DataFrame plans."""
