"""Structured Streaming jobs: counters, quotas, visits, lock-outs, idempotent intake."""
