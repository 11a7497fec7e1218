"""Readers and parsers that turn files and documents into the core tables, and the sinks."""
