"""Report plans: one lazy DataFrame per named read."""

from .reports import REPORTS  # noqa: F401
