"""Streams of a running crawl."""
