"""Scans, projections and sinks."""
