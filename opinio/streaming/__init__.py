"""Structured Streaming jobs (incremental ingest with global dedupe)."""

from .incremental import incremental_dedupe, incremental_dedupe_state, write_batches

__all__ = ["incremental_dedupe", "incremental_dedupe_state", "write_batches"]
