"""Streaming extensions of the batch operators."""
