"""What of the language holds for streams, and helpers for the rest."""

from .guard import UnsupportedInStreaming, require_batch, windowed_counts

__all__ = ["UnsupportedInStreaming", "require_batch", "windowed_counts"]
