"""Cohort audit and model evaluation on Spark DataFrames."""
