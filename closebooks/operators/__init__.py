"""DataFrame -> DataFrame operators, one module per finance domain."""
