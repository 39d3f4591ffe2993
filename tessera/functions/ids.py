"""Stable identifiers."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def stable_id(*parts) -> Column:
    """SHA-256 hex of the parts joined by U+0001: re-running a job gives the same
    id for the same input, so refreshes see real changes only."""
    cols = [(F.col(p) if isinstance(p, str) else p).cast("string") for p in parts]
    return F.sha2(F.concat_ws("\u0001", *cols), 256)
