"""Run-time helpers and composed jobs."""
