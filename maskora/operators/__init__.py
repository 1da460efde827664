"""operators of the redaction engine."""
