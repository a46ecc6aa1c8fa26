"""Readers and writers: archives, images, settings."""
