"""Models that grow with a stream of texts."""
