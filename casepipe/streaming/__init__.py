"""Structured Streaming entry points for incremental labelling."""

from casepipe.streaming.incremental import annotate_stream  # noqa: F401
