"""Memory of results for short arguments; long ones are worked out each time."""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache, wraps


def short_cache(maxsize: int, most: int = 600) -> Callable:
    """Like ``lru_cache`` for functions of one string, of at most ``most`` characters.

    The bound on the length bounds the memory of a worker whatever texts it meets.
    """

    def outer(f: Callable) -> Callable:
        kept = lru_cache(maxsize=maxsize)(f)

        @wraps(f)
        def inner(s: str):
            return kept(s) if len(s) <= most else f(s)

        return inner

    return outer
