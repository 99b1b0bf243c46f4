"""Change-feed processing with Structured Streaming (foreachBatch upserts)."""
