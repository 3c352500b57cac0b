"""Detectors (G2-G11).  Each takes the feature frame and returns (key..., raw score)."""
