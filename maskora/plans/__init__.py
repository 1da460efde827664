"""plans of the redaction engine."""
