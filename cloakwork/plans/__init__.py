"""plans of the text-anonymisation engine."""
