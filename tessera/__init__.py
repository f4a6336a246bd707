"""Set-based analytics jobs for research and market data on PySpark."""
