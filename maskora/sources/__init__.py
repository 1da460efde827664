"""sources of the redaction engine."""
