"""Column functions: expressions in, expressions out, no Python on the executors."""
