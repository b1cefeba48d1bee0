"""Structured Streaming variants of the stages that need no whole estate: filters, normalisation, paths, retention."""

from estatelens.streaming.stages import arrivals_per_window, classify_stream, stream_listing

__all__ = ["arrivals_per_window", "classify_stream", "stream_listing"]
