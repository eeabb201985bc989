"""One registry for everything that options name: scanners, ways to tell a user, download managers."""

from __future__ import annotations

from collections.abc import Callable

_kinds: dict[str, dict[str, Callable]] = {"scanner": {}, "auth": {}, "manager": {}}


def register(kind: str, name: str) -> Callable[[Callable], Callable]:
    """Adds a function under a kind and a name; a name that is taken raises ValueError."""

    def add(f: Callable) -> Callable:
        if name in _kinds[kind]:
            raise ValueError(f"{kind} {name} is registered twice")
        _kinds[kind][name] = f
        return f

    return add


def plugin(kind: str, name: str) -> Callable:
    if name not in _kinds[kind]:
        raise KeyError(f"no {kind} {name}; there are {sorted(_kinds[kind])}")
    return _kinds[kind][name]


def configured(kind: str, options: dict[str, str]) -> Callable:
    """The function that a plugin's options name by plugname."""
    return plugin(kind, options.get("plugname", ""))
