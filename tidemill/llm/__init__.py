"""Operators for preparing training text: each is a DataFrame-in, DataFrame-out Spark job."""
