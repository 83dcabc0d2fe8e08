"""Series as streams: resources over streaming DataFrames, and windowed aggregation of them."""

from .windows import windowed

__all__ = ["windowed"]
