"""Readers and writers of documents, archives and schemas."""
