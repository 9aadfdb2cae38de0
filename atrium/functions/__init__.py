"""functions of the indoor-map engine."""
