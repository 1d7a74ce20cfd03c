"""Structured Streaming forms of the weekly panel, the upsert and the audit log."""
