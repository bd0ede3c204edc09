"""Longitudinal panel analytics as DataFrame-to-DataFrame functions on Spark."""
