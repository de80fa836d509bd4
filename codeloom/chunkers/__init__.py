"""Chunkers: file content to chunks, by kind of file."""
