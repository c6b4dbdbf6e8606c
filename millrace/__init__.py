"""A compact analytics engine on PySpark: an SQL dialect, relational operators, stored tables and a cardinality estimator."""
