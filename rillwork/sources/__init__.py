"""Sources of records."""
