"""The scalar functions by name: REGISTRY["PMT"].build([Val, ...]) gives a Val."""

from . import dates, engineering, financial, logic, math, statistics, text  # noqa: F401
from .registry import REGISTRY

__all__ = ["REGISTRY"]
