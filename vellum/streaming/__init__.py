"""Structured Streaming: embedding in micro-batches, library sync, the job queue, and rolling metrics."""
