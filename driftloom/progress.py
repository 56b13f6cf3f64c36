"""A tree of stages with counts, told to reporters when they begin, move on and end."""

from __future__ import annotations

import logging
import time
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from dataclasses import dataclass, field


@dataclass
class Stage:
    name: str
    total: int | None = None
    done: int = 0
    children: list["Stage"] = field(default_factory=list)
    began: float = field(default_factory=time.monotonic)
    seconds: float | None = None

    def advance(self, n: int = 1) -> None:
        self.done += n
        _tell("moved", self)

    def lines(self, depth: int = 0) -> list[str]:
        count = f" {self.done}" + (f"/{self.total}" if self.total is not None else "")
        spent = "" if self.seconds is None else f" ({self.seconds:.1f} s)"
        return ["  " * depth + self.name + count + spent, *(x for c in self.children for x in c.lines(depth + 1))]


Reporter = Callable[[str, Stage], None]
_current: ContextVar[Stage | None] = ContextVar("stage", default=None)
_reporters: ContextVar[tuple[Reporter, ...]] = ContextVar("reporters", default=())


def _tell(what: str, stage: Stage) -> None:
    for r in _reporters.get():
        r(what, stage)


def log_reporter(what: str, stage: Stage) -> None:
    logging.getLogger("driftloom").info("%s: %s", what, stage.lines()[0])


@contextmanager
def reporting(*reporters: Reporter) -> Iterator[None]:
    token = _reporters.set((*_reporters.get(), *reporters))
    try:
        yield
    finally:
        _reporters.reset(token)


@contextmanager
def stage(name: str, total: int | None = None) -> Iterator[Stage]:
    own, parent = Stage(name, total), _current.get()
    if parent is not None:
        parent.children.append(own)
    token = _current.set(own)
    _tell("began", own)
    try:
        yield own
    finally:
        own.seconds = time.monotonic() - own.began
        _current.reset(token)
        _tell("ended", own)
