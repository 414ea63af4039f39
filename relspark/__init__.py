"""A relational analytics engine on PySpark."""
