"""Registered queries over the driver-made tables."""
