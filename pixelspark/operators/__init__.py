"""operators of the detector engine."""
