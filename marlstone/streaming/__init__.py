"""Incremental loads. The tables are batch tables; a stream of canonical rows is loaded batch by batch."""

from .incremental import load_stream

__all__ = ["load_stream"]
