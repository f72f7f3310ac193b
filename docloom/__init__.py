"""Document views of relational tables, on Spark."""
