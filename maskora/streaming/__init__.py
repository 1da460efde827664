"""streaming of the redaction engine."""
