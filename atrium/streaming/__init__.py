"""streaming of the indoor-map engine."""
