"""Statement analytics on Spark: positioned tokens in, validated transactions out."""
