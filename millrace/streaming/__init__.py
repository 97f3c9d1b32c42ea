"""Streaming of the posting-pipeline engine."""
