"""sources of the detector engine."""
