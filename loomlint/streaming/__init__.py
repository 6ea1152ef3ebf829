"""Incremental scans over file streams."""
