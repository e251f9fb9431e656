"""tessera: data-processing operators written for Spark's DataFrame and SQL engine."""
