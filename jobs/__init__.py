"""Runnable jobs over the library: an incremental index of documents and a batch search."""
