"""Scalar expressions over names and pixels, and the natural sort key."""
