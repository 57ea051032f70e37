"""Locks and counters that drivers share through a file system: one writer at a time, numbers given out once."""

from __future__ import annotations

import contextlib
import json
import os
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame

from corvane.operators.tenancy import blocks_needed, hilo


class Locked(TimeoutError):
    pass


class Lost(RuntimeError):
    """A lock that ran out and was taken by another."""


@dataclass
class Held:
    """A lock that is held: a file with its owner and the time it runs out."""

    path: Path
    owner: str
    lasts: float

    def _mine(self) -> bool:
        return (_read(self.path) or {}).get("owner") == self.owner

    def renew(self) -> None:
        """Another full term; raises if it isn't held any more."""
        if not self._mine():
            raise Lost(str(self.path))
        _place(self.path, self.owner, self.lasts, os.replace)

    def release(self) -> None:
        if self._mine():
            self.path.unlink(missing_ok=True)


def _read(path: Path) -> dict | None:
    try:
        return json.loads(path.read_text())
    except FileNotFoundError:
        return None
    except json.JSONDecodeError:
        return {}


def _place(path: Path, owner: str, lasts: float, how) -> None:
    """Write the lock beside its place and put it there whole."""
    beside = path.with_name(f"{path.name}.{owner}")
    beside.write_text(json.dumps({"owner": owner, "until": time.time() + lasts}))
    try:
        how(beside, path)
    finally:
        beside.unlink(missing_ok=True)


def _break(path: Path, seen: dict, owner: str) -> None:
    """Take a lock that ran out away; if it was another's new one by then, put it back."""
    aside = path.with_name(f"{path.name}.{owner}.old")
    try:
        os.rename(path, aside)
    except FileNotFoundError:
        return
    if _read(aside) != seen:
        with contextlib.suppress(FileExistsError):
            os.link(aside, path)
    aside.unlink(missing_ok=True)


@contextlib.contextmanager
def lock(path: str | Path, wait: float = 0.0, lasts: float = 600.0) -> Iterator[Held]:
    """Held by one driver at a time. It runs out after ``lasts`` seconds unless renewed, so that of a driver that died it is free again.

    Clocks of the drivers are taken to agree within a small part of ``lasts``.
    """
    path, until, owner = Path(path), time.monotonic() + wait, uuid.uuid4().hex
    held = Held(path, owner, lasts)
    while True:
        try:
            _place(path, owner, lasts, os.link)
            break
        except FileExistsError:
            seen = _read(path)
            if seen is not None and seen.get("until", 0) < time.time():
                _break(path, seen, owner)
            elif time.monotonic() >= until:
                raise Locked(str(path)) from None
            else:
                time.sleep(0.05)
    try:
        yield held
    finally:
        held.release()


@dataclass(frozen=True)
class Sequence:
    """A counter with a name in a folder that all drivers see; numbers go up and are given out once."""

    folder: str | Path
    name: str
    start: int = 1
    wait: float = 30.0

    @property
    def _path(self) -> Path:
        return Path(self.folder) / f"{self.name}.json"

    def _change(self, change) -> int:
        Path(self.folder).mkdir(parents=True, exist_ok=True)
        with lock(self._path.with_suffix(".lock"), self.wait) as held:
            at = json.loads(self._path.read_text())["next"] if self._path.exists() else self.start
            beside = self._path.with_suffix(f".{held.owner}")
            beside.write_text(json.dumps({"next": change(at)}))
            held.renew()  # nothing is given out by a driver that lost the lock
            os.replace(beside, self._path)
        return at

    def take(self, n: int = 1) -> int:
        """The first of ``n`` numbers that follow one another."""
        return self._change(lambda at: at + n)

    def floor(self, least: int) -> None:
        """Numbers from now on are ``least`` or more."""
        self._change(lambda at: max(at, least))

    def restart(self, at: int) -> None:
        self._change(lambda _: at)

    def peek(self) -> int:
        return json.loads(self._path.read_text())["next"] if self._path.exists() else self.start


@dataclass(frozen=True)
class HiLo:
    """Blocks of ``max_lo`` identities; the mark of the blocks given out is stored, so no two drivers get the same one."""

    folder: str | Path
    name: str
    max_lo: int = 1000

    @property
    def blocks(self) -> Sequence:
        return Sequence(self.folder, f"hilo_{self.name}", 0)

    def assign(self, df: DataFrame, by: str, *then: str, name: str = "id") -> DataFrame:
        """``df`` with identities from blocks of its own, in the order of ``by``."""
        first = self.blocks.take(blocks_needed(df.count(), self.max_lo))
        return hilo(df, by, *then, first_hi=first, max_lo=self.max_lo, name=name)

    def floor(self, least: int) -> None:
        """Identities from now on are above ``least``."""
        self.blocks.floor(-(-least // self.max_lo))
