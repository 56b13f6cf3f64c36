"""A cache of answers: a table keyed by hash, evicted by last use when it holds more bytes than it may, and one in memory."""

from __future__ import annotations

import threading
from collections import OrderedDict
from collections.abc import Callable
from concurrent.futures import Future
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftloom.session import placed


def cache_key(*parts: Column) -> Column:
    return F.sha2(F.to_json(F.array(*(p.cast("string") for p in parts))), 256)


def evict(cache: DataFrame, used_at: str, value: str, key: str, most_bytes: int) -> DataFrame:
    """The entries that stay: the last used ones whose lengths add up to at most ``most_bytes``; ties by key."""
    sums = placed(cache.withColumn("_s", F.length(value).cast("bigint")), [F.desc(used_at), key], {"_before": "_s"})
    return sums.where(F.col("_before") + F.coalesce("_s", F.lit(0)) <= most_bytes).drop("_s", "_before")


def missing_from(cache: DataFrame, prompts: DataFrame, key: str) -> DataFrame:
    """Distinct prompts that aren't cached yet: each is asked once."""
    return prompts.dropDuplicates([key]).join(cache.select(key), key, "left_anti")


def refreshed(cache: DataFrame, answers: DataFrame, now: Column, most_bytes: int) -> DataFrame:
    """(key, answer, used_at) of the cache after a run: what was used has the time of the run, what was asked is new, the rest is as old
    as it was; the last used ones stay that fit. Failed answers aren't kept.
    """
    used = answers.where("answer IS NOT NULL").select("key", "answer", now.alias("used_at"))
    rest = cache.select("key", "answer", "used_at").join(used, "key", "left_anti")
    return evict(used.unionByName(rest), "used_at", "answer", "key", most_bytes)


class Memory:
    """The last used answers of one process. Calls for the same key at the same time are one call."""

    def __init__(self, most: int) -> None:
        self.most, self._kept, self._running, self._lock = most, OrderedDict[Any, Any](), dict[Any, Future](), threading.Lock()

    def get(self, key: Any, make: Callable[[], Any]) -> Any:
        with self._lock:
            if key in self._kept:
                self._kept.move_to_end(key)
                return self._kept[key]
            running = self._running.get(key)
            if running is None:
                mine = self._running[key] = Future()
        if running is not None:
            return running.result()
        try:
            value = make()
        except BaseException as e:
            with self._lock:
                del self._running[key]
            mine.set_exception(e)
            raise
        with self._lock:
            self._kept[key] = value
            if len(self._kept) > self.most:
                self._kept.popitem(last=False)
            del self._running[key]
        mine.set_result(value)
        return value

    def clear(self) -> None:
        with self._lock:
            self._kept.clear()
