"""Streams of documents; profiles are kept up to date batch by batch."""
