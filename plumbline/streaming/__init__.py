"""Structured Streaming counterparts of incremental reading, first-seen deduplication and running counters."""

from plumbline.streaming.flows import first_seen, read_jsonl, running_counts, run_to_table, windowed_counts

__all__ = ["first_seen", "read_jsonl", "run_to_table", "running_counts", "windowed_counts"]
