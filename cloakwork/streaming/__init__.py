"""streaming of the text-anonymisation engine."""
