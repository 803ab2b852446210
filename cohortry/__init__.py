"""Patient-cohort analytics on Spark: lazy operators, DataFrame in and DataFrame out."""
