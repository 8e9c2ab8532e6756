"""Readers and writers, and the contracts tables must meet."""
