"""Running commands: configuration, paths, retries, locks, several at once."""

from __future__ import annotations

import contextlib
import logging
import os
import time
from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from typing import Any

log = logging.getLogger(__name__)
# How often and after how many seconds a failed command is tried again.
MAX_RETRIES, BACKOFF_S = 3, 5


def retry(f: Callable[[], Any], *, retries: int = MAX_RETRIES, backoff: float = BACKOFF_S, sleep: Callable[[float], None] = time.sleep) -> Any:
    """What `f` gives; after a failure it is tried `retries` times more, then the last error is raised."""
    for n in range(retries + 1):
        try:
            return f()
        except Exception as e:
            if n == retries:
                raise
            log.warning("%s, retrying (%d/%d)", e, n + 1, retries)
            sleep(backoff)


@contextlib.contextmanager
def exclusive(name: str, folder: str, *, wait: bool = False) -> Iterator[None]:
    """Holds the lock `name`; BlockingIOError if another process has it and `wait` isn't set."""
    import fcntl

    os.makedirs(folder, exist_ok=True)
    with open(os.path.join(folder, name.replace(os.sep, "_") + ".lock"), "w") as f:
        fcntl.flock(f, fcntl.LOCK_EX | (0 if wait else fcntl.LOCK_NB))
        try:
            yield
        finally:
            fcntl.flock(f, fcntl.LOCK_UN)


def in_parallel(f: Callable[..., Any], options: Iterable[dict[str, Any]], workers: int | None = None) -> list[Any]:
    """`f` with each set of options, several at a time in one session, whose jobs Spark runs side by side."""
    with ThreadPoolExecutor(max_workers=workers or os.cpu_count()) as pool:
        return list(pool.map(lambda o: f(**o), list(options)))


class Paths:
    """Named folders, given relative to each other and resolved when asked for."""

    def __init__(self) -> None:
        self._of: dict[str, str] = {}
        self._fixed: set[str] = set()

    def add(self, name: str, path: str, *, immutable: bool = False) -> Paths:
        self._of[name] = path
        if immutable:
            self._fixed.add(name)
        return self

    def get(self, name: str, *parts: str) -> str:
        if name not in self._of:
            raise KeyError(f"no path {name}")
        path = self._of[name]
        for _ in range(len(self._of) + 1):
            if "{" not in path:
                break
            path = path.format(**self._of)
        return "/".join([path.rstrip("/"), *[p.strip("/") for p in parts]])

    def check(self, path: str) -> str:
        """`path`, unless it lies in a folder that must not be changed."""
        for n in self._fixed:
            if path.startswith(self.get(n).rstrip("/") + "/") or path == self.get(n):
                raise PermissionError(f"{path} is in {n}, which is immutable")
        return path


def configure(text: str, env: dict[str, str] | None = None) -> dict[str, Any]:
    """Settings from YAML or JSON text; ${NAME} is taken from the environment, ${NAME:-x} with a default."""
    import re

    from dimforge.functions import yamlish

    env = dict(os.environ) if env is None else env

    def value(m: re.Match) -> str:
        if m[1] not in env and m[2] is None:
            raise KeyError(f"{m[1]} isn't set")
        return env.get(m[1], m[2] or "")

    got = yamlish.mapping(re.sub(r"\$\{(\w+)(?::-([^}]*))?\}", value, text))
    if got is None:
        raise ValueError("settings must be a mapping")
    return got


class Hooks:
    """Functions to be called at named moments, the lowest priority first; equal ones in the order they were added."""

    def __init__(self) -> None:
        self._of: dict[str, list[tuple[int, int, Callable[..., Any]]]] = {}

    def add(self, moment: str, f: Callable[..., Any], priority: int = 0) -> None:
        known = self._of.setdefault(moment, [])
        known.append((priority, len(known), f))

    def call(self, moment: str, *args: Any) -> list[Any]:
        return [f(*args) for _, _, f in sorted(self._of.get(moment, []), key=lambda x: x[:2])]
