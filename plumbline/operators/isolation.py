"""Running many things at once so that one which fails costs only itself."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import TypeVar

Item = TypeVar("Item")
Result = TypeVar("Result")


def halved(items: Sequence[Item], attempt: Callable[[Sequence[Item]], Result]) -> tuple[list[Result], list[tuple[Item, Exception]]]:
    """Results of independent items, and the items that failed with what they raised.

    All are attempted together. Only if that fails are they attempted in halves, down to single
    ones, so ``k`` failures among ``n`` items cost about ``k log n`` attempts more.
    """
    if not items:
        return [], []
    try:
        return [attempt(items)], []
    except Exception as error:  # noqa: BLE001 - whatever an item raises is its own
        if len(items) == 1:
            return [], [(items[0], error)]
    middle = len(items) // 2
    left, right = (halved(part, attempt) for part in (items[:middle], items[middle:]))
    return left[0] + right[0], left[1] + right[1]


def surviving(items: Sequence[Item], attempt: Callable[[Sequence[Item]], Result], before: Sequence[Item] = ()) -> tuple[list[Item], list[tuple[Item, Exception]]]:
    """The items of a sequence that can be carried out one after another, and those that cannot.

    ``attempt`` gets the items that are known to work and some more, in order.
    """
    if not items:
        return [], []
    try:
        attempt([*before, *items])
        return list(items), []
    except Exception as error:  # noqa: BLE001
        if len(items) == 1:
            return [], [(items[0], error)]
    middle = len(items) // 2
    first, refused = surviving(items[:middle], attempt, before)
    second, more = surviving(items[middle:], attempt, [*before, *first])
    return first + second, refused + more


def reason(error: Exception) -> str:
    """What went wrong, in one line."""
    lines = [line for line in str(error).splitlines() if line.strip()]
    return f"{type(error).__name__}: {lines[0].strip()}" if lines else type(error).__name__
