"""plans of the detector engine."""
