"""The lazy dataset API."""
