"""DataFrame operators and pyspark.ml stages."""
