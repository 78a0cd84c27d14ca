"""Structured Streaming forms of the crawl transforms."""
