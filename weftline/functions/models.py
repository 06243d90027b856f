"""Asking a model for many texts of which some may fail."""

from __future__ import annotations

from collections.abc import Callable


def halved(model: Callable[[list], list], items: list) -> list:
    """An answer for each item, null where the model fails.

    Where it raises, or gives another number of answers, the batch is halved until what fails is alone.
    """
    try:
        got = list(model(items))
        if len(got) != len(items):
            raise ValueError(f"{len(got)} answers for {len(items)} texts")
        return got
    except Exception:  # a model may fail in any way, and that is the result
        if len(items) <= 1:
            return [None] * len(items)
        half = len(items) // 2
        return halved(model, items[:half]) + halved(model, items[half:])
