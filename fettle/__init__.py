"""Workforce-welfare early warning on Spark: DataFrame in, DataFrame out."""
