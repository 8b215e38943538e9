"""Column functions: plain expressions over built-ins, plus one codec pandas UDF."""
