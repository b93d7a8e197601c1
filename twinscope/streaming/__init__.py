"""Streams of fingerprints against a static gallery (an extension)."""
