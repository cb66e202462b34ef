"""Decoding token streams: part by part, with or without state."""
