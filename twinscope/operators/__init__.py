"""Operators over pairs, scores and fingerprints, as DataFrame transformations."""
