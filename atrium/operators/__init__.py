"""operators of the indoor-map engine."""
