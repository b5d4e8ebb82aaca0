"""Structured Streaming: incremental upserts and job status."""
