"""Settings that queries are planned with.

A query's plan is made on the driver, so what a stage sets reaches its operators by being set while the plan is made; a query
called outside has the operators' defaults.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from contextlib import contextmanager
from contextvars import ContextVar
from typing import Any

_chosen: ContextVar[Mapping[str, Any]] = ContextVar("settings", default={})


def chosen(name: str, default: Any) -> Any:
    """The value that is set, or the default."""
    return _chosen.get().get(name, default)


@contextmanager
def using(values: Mapping[str, Any]) -> Iterator[None]:
    """Set values for the plans that are made inside; those that are set further out stay where they are not set anew."""
    before = _chosen.set({**_chosen.get(), **values})
    try:
        yield
    finally:
        _chosen.reset(before)
