"""Reports composed from the operators, and the registry of named queries."""
