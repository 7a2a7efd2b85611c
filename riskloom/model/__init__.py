"""Label encoding, fold assignment and cross-validated scoring on pyspark.ml."""
