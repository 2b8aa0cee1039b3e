"""Column functions: monoids and scalar expressions."""
