"""Leafmill sinks."""
