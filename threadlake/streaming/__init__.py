"""Streams of transcript lines into the store."""
