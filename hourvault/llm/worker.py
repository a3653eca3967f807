"""What a Python worker keeps from one task to the next: loaded tokenizers, models, caches, and no more."""

from __future__ import annotations

import sys
import types
from collections.abc import Callable
from typing import Any

from hourvault.lean import give_back, lean

__all__ = ["give_back", "kept", "lean"]

_HOME = "hourvault_worker_state"


def kept(key: tuple, make: Callable[[], Any]) -> Any:
    """The object made for this key in this worker process, made at the first call.

    A worker keeps one: another key's object takes its place, as a later stage needs
    no tables of an earlier one. Task code travels by value, so its own module globals are new in each task.
    """
    home = sys.modules.setdefault(_HOME, types.ModuleType(_HOME))
    store = home.__dict__.setdefault("store", {})
    if key not in store:
        store.clear()
        store[key] = make()
    return store[key]
