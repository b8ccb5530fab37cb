"""Structured Streaming versions of the crawl operators."""
