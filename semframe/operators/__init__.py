"""Dataflow operators over record frames."""
