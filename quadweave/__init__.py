"""quadweave: incremental knowledge graphs and tabular change processing on PySpark."""
