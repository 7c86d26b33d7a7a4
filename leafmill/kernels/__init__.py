"""Leafmill kernels."""
