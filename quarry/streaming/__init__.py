"""Streaming: intentionally empty.

The reference uses no streaming source, watermark, window or stateful
operator, so there is nothing to re-express with Structured Streaming here.
All operators are batch DataFrame functions.
"""
