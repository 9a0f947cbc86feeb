"""Streams: deduplicated ingest, session windows, running numbers, versions of sources."""
