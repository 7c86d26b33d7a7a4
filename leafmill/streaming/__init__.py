"""Leafmill streaming."""
