"""Source files to definitions and call sites."""

from callscope.parse.records import parse_source

__all__ = ["parse_source"]
