"""streaming of the detector engine."""
