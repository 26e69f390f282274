"""Structured Streaming forms of the word store and of token counts."""
