"""Readers and writers for every table the engine keeps."""
