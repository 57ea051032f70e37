"""Commands with bound values, and batches of queries that run together."""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping, Sequence
from concurrent.futures import Future, ThreadPoolExecutor
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class Command:
    """SQL text put together in pieces; values never become text."""

    def __init__(self) -> None:
        self._text: list[str] = []
        self.args: dict[str, Any] = {}

    def append(self, text: str) -> Command:
        self._text.append(text)
        return self

    def parameter(self, value: Any) -> Command:
        """A value under a name of its own."""
        name = f"p{len(self.args)}"
        self.args[name] = value
        return self.append(f":{name}")

    def named(self, name: str, value: Any) -> Command:
        """A value under a name; a name that is taken keeps its first value."""
        self.args.setdefault(name, value)
        return self

    def with_values(self, text: str, values: Sequence[Any], token: str = "?") -> Command:
        parts = text.split(token)
        if len(parts) - 1 != len(values):
            raise ValueError(f"{len(parts) - 1} places for {len(values)} values")
        for piece, v in zip(parts, values, strict=False):
            self.append(piece).parameter(v)
        return self.append(parts[-1])

    def group(self, values: Sequence[Any], separator: str = ", ") -> Command:
        for i, v in enumerate(values):
            self.append(separator * bool(i)).parameter(v)
        return self

    @property
    def text(self) -> str:
        return "".join(self._text).strip()

    def run(self, spark: SparkSession) -> DataFrame:
        args = {k: F.array(*map(F.lit, v)) if isinstance(v, (list, tuple)) else v for k, v in self.args.items()}
        return spark.sql(self.text, args=args) if args else spark.sql(self.text)


def run(spark: SparkSession, sql: str, args: Mapping[str, Any] | Sequence[Any] | None = None) -> DataFrame:
    return spark.sql(sql, args=args) if args else spark.sql(sql)


#: Rows of a result that the driver takes.
MOST_ROWS = 1_000_000


class TooManyRows(RuntimeError):
    pass


def fetched(df: DataFrame, most: int = MOST_ROWS) -> list:
    """All rows on the driver; raises, before it holds more, if there are more than ``most``."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise TooManyRows(f"a result of more than {most} rows; write it, or raise the bound")
    return rows


def fetch_list(df: DataFrame, transform: Callable | None = None, most: int = MOST_ROWS) -> list:
    """All rows through a function, or their first column."""
    return [transform(r) if transform else r[0] for r in fetched(df, most)]


def fetch_one(df: DataFrame, default: Any = None) -> Any:
    """First column of the first row."""
    row = df.first()
    return default if row is None else row[0]


class Batch:
    """Queries queued as futures and run at once; a batch is used once."""

    def __init__(self, threads: int = 8) -> None:
        self._queued: list[tuple[Future, Callable[[], Any]]] = []
        self._threads, self._done = threads, False

    def _queue(self, work: Callable[[], Any]) -> Future:
        if self._done:
            raise RuntimeError("a batch runs once")
        f: Future = Future()
        self._queued.append((f, work))
        return f

    def query(self, df: DataFrame, most: int = MOST_ROWS) -> Future:
        return self._queue(lambda: fetched(df, most))

    def single(self, df: DataFrame, *order: str | Column) -> Future:
        """First row by ``order``, or None."""
        if not order:
            raise ValueError("a first row needs an order")
        return self._queue(lambda: df.orderBy(*order).first())

    def scalar(self, df: DataFrame, default: Any = None) -> Future:
        return self._queue(lambda: fetch_one(df, default))

    def execute(self) -> None:
        if self._done:
            raise RuntimeError("a batch runs once")
        self._done = True

        def settle(f: Future, work: Callable[[], Any]) -> None:
            try:
                f.set_result(work())
            except BaseException as e:  # each future carries its own failure
                f.set_exception(e)

        with ThreadPoolExecutor(self._threads) as pool:
            list(pool.map(lambda x: settle(*x), self._queued))
        if not all(f.done() for f, _ in self._queued):
            raise RuntimeError("fewer results than queries")


def statements(script: str) -> list[str]:
    """Statements of a script, split at semicolons outside of quotes."""
    parts = re.findall(r"(?:'(?:[^'\\]|\\.|'')*'|`(?:[^`]|``)*`|--[^\n]*|[^;'`])+", script)
    return [p.strip() for p in parts if re.sub(r"--[^\n]*", "", p).strip()]


def run_script(spark: SparkSession, script: str) -> None:
    for s in statements(script):
        spark.sql(s)
