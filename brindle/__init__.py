"""brindle: a Spark-first analytics engine."""
