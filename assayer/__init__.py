"""Data quality on Spark: profile, validate, watch, recommend and repair wide tables."""
