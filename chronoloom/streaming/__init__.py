"""Structured Streaming twins of the causal operators; a replay of files gives what the batch operators give."""
