"""functions of the redaction engine."""
