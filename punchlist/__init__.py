"""Construction-records analytics as Spark DataFrame operators."""
