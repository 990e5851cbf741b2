"""operators of the text-anonymisation engine."""
