"""Column functions; all are compositions of built-in Spark SQL functions."""
