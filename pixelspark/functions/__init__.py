"""functions of the detector engine."""
