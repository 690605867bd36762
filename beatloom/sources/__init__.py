"""Readers and writers."""

from .tables import load

__all__ = ["load"]
