"""Column functions: DataFrame-free building blocks shared by the operators."""
