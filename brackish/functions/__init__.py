"""Column expressions: gates, energy balance, meteorology, spectral indices, calendar."""
