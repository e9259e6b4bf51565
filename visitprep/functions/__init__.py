"""Column-level building blocks of the operators."""
