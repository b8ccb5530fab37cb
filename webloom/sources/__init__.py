"""Readers and writers for pages, robots files, sitemaps and crawl logs."""
