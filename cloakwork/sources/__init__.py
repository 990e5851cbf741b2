"""sources of the text-anonymisation engine."""
