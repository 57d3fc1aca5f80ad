"""Column builders: projections, scalar functions, conditions and expressions."""
