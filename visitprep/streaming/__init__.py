"""Streams of record transmissions."""

from .latest import keep_latest

__all__ = ["keep_latest"]
