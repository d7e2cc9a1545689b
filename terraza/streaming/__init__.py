"""Structured Streaming: an extension, as the batch operators need no stream."""
