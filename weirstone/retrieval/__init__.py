"""Retrieval over Markdown documents: chunks, vectors, exact top-k, extractive answers."""
