"""Sources of the posting-pipeline engine."""

from millrace.sources import feeds, listings  # listings adds its feeds to feeds.FEEDS

__all__ = ["feeds", "listings"]
