"""Column functions shared by all operators."""
