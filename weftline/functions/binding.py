"""Binding of call inputs to a function's parameters."""

from __future__ import annotations

import functools
import inspect
from collections.abc import Callable
from typing import Any

RESERVED = ("id", "storage")
#: What is known of built-in functions without a signature.
_ANY = inspect.Signature([inspect.Parameter("args", inspect.Parameter.VAR_POSITIONAL), inspect.Parameter("kwargs", inspect.Parameter.VAR_KEYWORD)])


def as_calls(iterdata: Any) -> list:
    """Ranges and sets become lists; anything else that is not a list is one call."""
    if isinstance(iterdata, (range, set)):
        return list(iterdata)
    return list(iterdata) if type(iterdata) is list else [iterdata]


def extended(element: Any, extra: Any) -> Any:
    """``element`` with extra arguments: appended to a tuple, merged into a dict, after a scalar."""
    if extra is None:
        return element
    if isinstance(element, dict):
        if not isinstance(extra, dict):
            raise ValueError("extra arguments of a dict element must be a dict")
        return {**element, **extra}
    if not isinstance(extra, tuple):
        raise ValueError("extra arguments must be a tuple")
    return (*element, *extra) if isinstance(element, tuple) else (element, *extra)


@functools.lru_cache(maxsize=256)
def _known(function: Callable) -> inspect.Signature:
    try:
        return inspect.signature(function)
    except ValueError:
        return _ANY


def signature(function: Callable) -> inspect.Signature:
    try:
        return _known(function)
    except TypeError:  # it cannot be hashed
        return _known.__wrapped__(function)


@functools.lru_cache(maxsize=256)
def _by_place(function: Callable) -> tuple[tuple[str, ...], int] | None:
    """The names of a function's own parameters and how many of these need a value; None if some cannot be given both by place and by name."""
    own = [p for p in signature(function).parameters.values() if p.name not in RESERVED]
    if any(p.kind is not p.POSITIONAL_OR_KEYWORD for p in own):
        return None
    return tuple(p.name for p in own), sum(p.default is p.empty for p in own)


def bind(function: Callable, element: Any) -> dict[str, Any]:
    """Arguments by name.  A dict must hold every parameter, defaults included, unless there is ``**kw``."""
    if not isinstance(element, dict):
        given = element if isinstance(element, tuple) else (element,)
        try:
            plain = _by_place(function)
        except TypeError:  # it cannot be hashed
            plain = None
        if plain and plain[1] <= len(given) <= len(plain[0]):
            return dict(zip(plain[0], given, strict=False))
    whole = signature(function)
    own = [p for p in whole.parameters.values() if p.name not in RESERVED]
    if isinstance(element, dict):
        loose = any(p.kind is p.VAR_KEYWORD for p in own)
        missing = {p.name for p in own if p.kind not in (p.VAR_KEYWORD, p.VAR_POSITIONAL)} - set(element)
        if missing and not loose:
            raise ValueError(f"missing arguments: {', '.join(sorted(missing))}")
        return dict(element)
    return dict(whole.replace(parameters=own).bind(*given).arguments)


class Caller:
    """A function that takes bound arguments: starred ones are unpacked, positional-only ones honoured, and ``id`` and ``storage`` given where they are declared."""

    def __init__(self, function: Callable):
        params = list(signature(function).parameters.values())
        star = next((i for i, p in enumerate(params) if p.kind is p.VAR_POSITIONAL), None)
        self.function = function
        self.injected = [p.name for p in params if p.name in RESERVED]
        self.first = [p.name for p in (params[:star] if star is not None else params) if star is not None or p.kind is p.POSITIONAL_ONLY]
        self.star = params[star].name if star is not None else None
        self.rest = next((p.name for p in params if p.kind is p.VAR_KEYWORD), None)
        self.plain = not (self.injected or self.first or self.star or self.rest)

    def __call__(self, bound: dict[str, Any], given: dict[str, Any]) -> Any:
        if self.plain:
            return self.function(**bound)
        named = {**{n: given.get(n) for n in self.injected}, **bound}
        positional = []
        for name in self.first:
            if name not in named:
                break
            positional.append(named.pop(name))
        if self.star:
            positional += named.pop(self.star, ())
        if self.rest in named:
            named = {**named.pop(self.rest), **named}
        return self.function(*positional, **named)


def invoke(function: Callable, bound: dict[str, Any], call_id: int, storage: Any = None) -> Any:
    return Caller(function)(bound, {"id": call_id, "storage": storage})
