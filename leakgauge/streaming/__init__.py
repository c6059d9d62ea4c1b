"""Streams over the call ledger."""
