"""Judges, cost planning and the spend ledger."""
