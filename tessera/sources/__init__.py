"""Panels, files and state tables."""
