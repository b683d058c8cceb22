"""Streaming use of fitted stages."""
