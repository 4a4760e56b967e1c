"""Incremental ingest of documents as a stream of batches."""
