"""sources of the indoor-map engine."""
