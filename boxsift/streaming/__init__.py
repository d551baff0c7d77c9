"""Streams of rule requests: each request is judged on its own, so no state and no watermark is kept."""

from boxsift.streaming.requests import evaluate_stream

__all__ = ["evaluate_stream"]
