"""Safe, realistic test data from relational tables, as Spark DataFrame plans."""
