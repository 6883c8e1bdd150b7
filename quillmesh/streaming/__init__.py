"""Streams: additions to the document-graph model, which itself has none."""
