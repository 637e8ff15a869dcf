"""Column expressions: projections, binary headers, coordinate-system texts, geometry."""
