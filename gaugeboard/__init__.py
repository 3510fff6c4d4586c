"""Dataset profiling, dashboard data and catalogue queries on PySpark."""
