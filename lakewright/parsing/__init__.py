"""Parsing of source files and documents into symbols and chunks."""
