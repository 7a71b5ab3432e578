"""Structured Streaming forms of registration, retries and health."""
