"""DataFrame operators: profiling, insights, catalogue queries and analyses."""
