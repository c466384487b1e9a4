"""Built-in functions of the dialect as Spark columns."""
