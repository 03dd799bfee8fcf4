"""Tick pipelines on Structured Streaming, and jobs."""
