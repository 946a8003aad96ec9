"""Versioned keyed data on Spark: every capability is a DataFrame-to-DataFrame transformation."""
