"""Scans, sinks and DDL helpers."""
