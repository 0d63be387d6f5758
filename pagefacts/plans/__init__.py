"""The registered queries; importing this package fills the register."""

from . import gates, hits, pages, records, runs, streams

__all__ = ["gates", "hits", "pages", "records", "runs", "streams"]
