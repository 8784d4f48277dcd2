"""Readers of stored crawl results and writers of deliverables."""
