"""functions of the text-anonymisation engine."""
