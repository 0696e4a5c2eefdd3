"""Idempotency keys that a stream has taken."""

from __future__ import annotations

from footfall.schemas import struct
from footfall.streaming.runs import DIGITS, FAN, Runs

KEYS = struct("project_id string, key_hash string")


def key_index(path: str, fan: int = FAN, digits: int = DIGITS) -> Runs:
    """The keys of every batch, each once: a batch adds distinct keys that no earlier one has."""
    return Runs(path, KEYS, "key_hash", fan=fan, digits=digits)
