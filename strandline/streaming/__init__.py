"""Streams: the operators here are batch; sessions() is the one with a streaming form."""
