"""Captures as input: discovery, headers, packets."""
