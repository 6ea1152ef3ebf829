"""Assembled plans: queries over driver tables and whole scans."""
