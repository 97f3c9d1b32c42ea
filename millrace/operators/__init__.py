"""Operators of the posting-pipeline engine."""
