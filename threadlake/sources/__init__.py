"""Readers of transcripts, prompt logs and plans, and the store they are written to."""
