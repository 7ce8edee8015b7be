"""Operators for training data; nothing else in the library imports them."""

from ._common import scratch

__all__ = ["scratch"]
