"""Plans of the posting-pipeline engine."""
