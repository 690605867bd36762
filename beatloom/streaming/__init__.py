"""Structured Streaming versions of the sliding audit and of speech activity (an extension)."""

from .live import sliding_activity, speech_sessions

__all__ = ["sliding_activity", "speech_sessions"]
