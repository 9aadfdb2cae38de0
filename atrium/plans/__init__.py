"""plans of the indoor-map engine."""
