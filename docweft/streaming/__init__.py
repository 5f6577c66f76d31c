"""Streaming forms of the job and review state machines."""
