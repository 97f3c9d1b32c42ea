"""Functions of the posting-pipeline engine."""
