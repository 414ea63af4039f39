"""Where rows come from and go to."""

from relspark.sources.files import load, read, register, write

__all__ = ["load", "read", "register", "write"]
