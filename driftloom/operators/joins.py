"""Named access paths to secondary tables: lookup, keyed time series, conversations; batch forms first.

Each is one equi-join: on the key, or on key and block of time where a range is asked for; AQE splits keys that hold too many rows.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import groupby
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from driftloom.functions.hashing import portable_hash
from driftloom.session import prefix_sums


@dataclass(frozen=True)
class Lookup:
    """One row per key."""

    name: str
    table: DataFrame
    key: str
    columns: tuple[str, ...]

    def get(self, value: Any) -> dict | None:
        """The row of one key, none if absent; two rows are an error."""
        rows = self.table.where(F.col(self.key) == F.lit(value)).select(*self.columns).limit(2).collect()
        if len(rows) > 1:
            raise ValueError(f"{self.name}: more than one row for {value!r}")
        return rows[0].asDict() if rows else None

    def batch(self, keys: DataFrame, key: str) -> DataFrame:
        """``keys`` with the looked-up columns, null where absent; repeated keys stay, repeated rows of the table fan out."""
        return keys.join(self.table.select(F.col(self.key).alias("_k"), *self.columns), F.col(key) == F.col("_k"), "left").drop("_k")

    def get_batch(self, values: list) -> DataFrame:
        """(key, columns…) of the given keys, in their order; repeated keys repeat, absent ones have nulls."""
        kind = self.table.schema[self.key].dataType.simpleString()
        asked = self.table.sparkSession.createDataFrame(list(enumerate(values)), f"_at long, `{self.key}` {kind}")
        found = F.broadcast(asked).join(self.table.select(F.col(self.key).alias("_k"), *self.columns), F.col(self.key) == F.col("_k"), "left")  # the caller's list
        return found.orderBy("_at", *self.columns).select(self.key, *(c for c in self.columns if c != self.key))


@dataclass(frozen=True)
class Window:
    """An interval of time around each row, with its ends included or not, and at most ``cap`` rows of it."""

    start: Column | str
    end: Column | str
    include_start: bool = True
    include_end: bool = False
    cap: int | None = None

    def ends(self) -> tuple[Column, Column]:
        return tuple(F.expr(x) if isinstance(x, str) else x for x in (self.start, self.end))

    def holds(self, at: Column, start: Column, end: Column) -> Column:
        return (at >= start if self.include_start else at > start) & (at <= end if self.include_end else at < end)


@dataclass(frozen=True)
class TimeSeries:
    """Many dated rows per key."""

    name: str
    table: DataFrame
    key: str
    at: str
    columns: tuple[str, ...]

    def rows(self, keys: DataFrame, key: str, window: Window, tie: str | None = None) -> DataFrame:
        """``keys`` joined with the rows of their window. Keys without rows stay, with ``key_exists`` telling an empty
        window of a known key from an unknown key. With a cap, the rows of a window with the least hashes of ``tie`` are kept.
        """
        if window.cap is None:
            own = self._leveled(keys, key, window)
            series = self._blocked(self._levels(own), list(dict.fromkeys([*self.columns, *([tie] if tie else [])])))
            same = (F.col(key) == F.col("_key")) & (F.col("_level") == F.col("_at.l")) & (F.expr("shiftright(_a, _level)") == F.col("_at.b"))
            joined = own.join(series, same & window.holds(F.col("at"), F.col("_start"), F.col("_end")), "left").drop("_key", "_at", "_a", "_b", "_level", "_start", "_end")
            return self._with_existence(joined, key)
        own, matched = self._matched(keys, key, window, tie)
        on = F.col(key).eqNullSafe(F.col("_k")) & F.col("_start").eqNullSafe(F.col("_s")) & F.col("_end").eqNullSafe(F.col("_e"))
        joined = own.join(matched, on, "left").drop("_k", "_s", "_e", "_start", "_end")
        return self._with_existence(joined, key)

    def series(self, keys: DataFrame, key: str, window: Window, tie: str | None = None) -> DataFrame:
        """``keys`` with ``series``: null for an unknown key, an empty array for an empty window, else rows ordered by time."""
        own, matched = self._matched(keys, key, window, tie)
        item = F.struct("at", *self.columns)
        lists = matched.groupBy("_k", "_s", "_e").agg(F.sort_array(F.collect_list(item)).alias("_list"))
        on = F.col(key).eqNullSafe(F.col("_k")) & F.col("_start").eqNullSafe(F.col("_s")) & F.col("_end").eqNullSafe(F.col("_e"))
        joined = self._with_existence(own.join(lists, on, "left").drop("_k", "_s", "_e", "_start", "_end"), key)
        return joined.select(*keys.columns, F.when(F.col("key_exists"), F.coalesce("_list", F.array().cast(lists.schema["_list"].dataType))).alias("series"))

    def exist(self, keys: DataFrame, key: str) -> DataFrame:
        """``keys`` with ``key_exists``."""
        return self._with_existence(keys, key)

    def _with_existence(self, df: DataFrame, key: str) -> DataFrame:
        known = self.table.select(F.col(self.key).alias("_known")).distinct()
        return df.join(known, F.col(key) == F.col("_known"), "left").withColumn("key_exists", F.col("_known").isNotNull()).drop("_known")

    # Time is cut into blocks as long as a window, its length rounded up to a power of two (the level), so a window meets no more than
    # the block it begins in and the next. Each row of the series stands in its own block and in the one before; so a window finds
    # each of its rows once, by the block it begins in. The join is on key and block: a key that holds any share of the rows is
    # spread over its blocks, and what meets is no more than a few times what matches.

    def _leveled(self, keys: DataFrame, key: str, window: Window) -> DataFrame:
        """``keys`` with _start, _end, _a and _b (both in microseconds) and _level."""
        start, end = window.ends()
        micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
        own = keys.withColumns({"_start": start, "_end": end}).withColumns({"_a": micros("_start"), "_b": micros("_end")})
        return own.withColumn("_level", F.when(F.col("_a") <= F.col("_b"), F.ceil(F.log2(F.greatest(F.col("_b") - F.col("_a"), F.lit(1)).cast("double"))).cast("int")))

    def _levels(self, leveled: DataFrame) -> list[int]:
        return sorted(r[0] for r in leveled.where("_level IS NOT NULL").select("_level").distinct().collect())  # at most 64

    def _blocked(self, levels: list[int], columns: list[str]) -> DataFrame:
        series = self.table.select(F.col(self.key).alias("_key"), F.col(self.at).alias("at"), *columns).where("_key IS NOT NULL AND at IS NOT NULL")
        at = F.unix_micros(F.col("at").cast("timestamp"))
        blocks = F.array(*(F.struct(F.lit(x).alias("l"), (F.shiftright(at, x) - i).alias("b")) for x in levels for i in (0, 1))) if levels else F.expr("array_repeat(struct(0 AS l, 0L AS b), 0)")
        return series.withColumn("_at", F.explode(blocks))

    def _matched(self, keys: DataFrame, key: str, window: Window, tie: str | None) -> tuple[DataFrame, DataFrame]:
        """``keys`` with _start and _end, and (_k, _s, _e, at, columns) of the distinct windows and their rows."""
        if window.cap is not None and tie is None:
            raise ValueError("a cap needs a unique column to choose by")
        own = self._leveled(keys, key, window)
        columns = list(dict.fromkeys([*self.columns, *([tie] if tie else [])]))
        spans = own.select(F.col(key).alias("_k"), F.col("_start").alias("_s"), F.col("_end").alias("_e"), "_level", F.expr("shiftright(_a, _level)").alias("_block")).where("_k IS NOT NULL AND _level IS NOT NULL").distinct()
        same = (F.col("_k") == F.col("_key")) & (F.col("_level") == F.col("_at.l")) & (F.col("_block") == F.col("_at.b"))
        matched = spans.join(self._blocked(self._levels(own), columns), same & window.holds(F.col("at"), F.col("_s"), F.col("_e"))).select("_k", "_s", "_e", "at", *columns)
        if window.cap is not None:
            place = F.row_number().over(W.partitionBy("_k", "_s", "_e").orderBy(portable_hash(F.col(tie)), tie))
            matched = matched.withColumn("_r", place).where(F.col("_r") <= window.cap).drop("_r")
        return own.drop("_a", "_b", "_level"), matched


@dataclass(frozen=True)
class Conversations:
    """One row per message."""

    name: str
    table: DataFrame
    id: str
    at: str
    role: str
    content: str
    tie: str

    def rows(self) -> DataFrame:
        """All messages with ``position`` from 0 in their conversation, whatever its length."""
        timed = self.table.where(F.col(self.at).isNotNull() & F.col(self.id).isNotNull())
        return positions(timed, [self.id], self.at, self.tie, "position")

    def get(self, ids: DataFrame, id: str) -> DataFrame:
        """``ids`` with ``messages``, an array ordered by time (ties by ``tie``); null where there is no conversation.

        For the conversations of a few ids: each becomes one value, whatever its length. Whole tables take ``rows`` or
        ``chunks``, whose values are bounded.
        """
        item = F.struct(F.col(self.at).alias("at"), F.col(self.tie).alias("tie"), F.col(self.role).alias("role"), F.col(self.content).alias("content"))
        timed = self.table.where(F.col(self.at).isNotNull())
        fit = timed.join(ids.select(F.col(id).alias(self.id)).distinct(), self.id, "left_semi")
        built = fit.groupBy(self.id).agg(F.array_sort(F.collect_list(item)).alias("messages"))
        return ids.join(built.withColumnRenamed(self.id, "_id"), F.col(id) == F.col("_id"), "left").drop("_id")

    def chunks(self, dated: bool = False, size: int = 65_536) -> DataFrame:
        """(id, chunk_no, text): the text of every conversation, whatever its length, in chunks of whole lines.

        The texts of a conversation put together in the order of ``chunk_no`` are ``dated_lines`` or ``role_lines`` of all its
        messages. A chunk holds the lines that begin in its ``size`` characters; numbers rise from 0 and skip those inside a longer line.
        """
        timed = self.table.where(F.col(self.at).isNotNull() & F.col(self.id).isNotNull())
        if dated:
            # the day changes exactly where the first message of a day stands
            timed = with_new_day(timed, [self.id], self.at, self.tie)
            header = F.when(F.col("new_day"), F.concat(F.lit("Date: "), F.date_format(self.at, "yyyy-MM-dd"), F.lit("\n"))).otherwise("")
            line = F.concat(header, F.lit("["), F.date_format(self.at, "HH:mm:ss"), F.lit("] ["), self.role, F.lit("] "), self.content)
        else:
            line = F.concat(F.initcap(self.role), F.lit(": "), self.content)
        lines = timed.select(self.id, self.at, self.tie, line.alias("_line")).where(F.col("_line").isNotNull()).withColumns({"_one": F.lit(1), "_size": F.length("_line") + 1})
        placed = prefix_sums(lines, [self.id], self.at, ["_one", "_size"], ["_at", "_from"], F.date_trunc("hour", F.col(self.at)), [self.tie])
        piece = F.concat("_line", F.lit("\n")) if dated else F.concat(F.when(F.col("_at") > 0, "\n").otherwise(""), "_line")
        numbered = placed.select(self.id, F.floor(F.col("_from") / size).alias("chunk_no"), F.struct(F.col(self.at).alias("at"), F.col(self.tie).alias("tie"), piece.alias("piece")).alias("_item"))
        built = numbered.groupBy(self.id, "chunk_no").agg(F.array_sort(F.collect_list("_item")).alias("_items"))
        return built.select(self.id, "chunk_no", F.array_join(F.col("_items.piece"), "").alias("text"))

    def exist(self, ids: DataFrame, id: str) -> DataFrame:
        """``ids`` with ``id_exists``."""
        known = self.table.select(F.col(self.id).alias("_id")).distinct()
        return ids.join(known, F.col(id) == F.col("_id"), "left").withColumn("id_exists", F.col("_id").isNotNull()).drop("_id")

    def only_existing(self, ids: DataFrame, id: str) -> DataFrame:
        return ids.join(self.table.select(F.col(self.id).alias(id)), id, "left_semi")


def only_with(df: DataFrame, key: str, other: DataFrame, other_key: str) -> DataFrame:
    """Rows whose key the other table has."""
    return df.join(other.select(F.col(other_key).alias(key)), key, "left_semi")


def only_without(df: DataFrame, key: str, other: DataFrame, other_key: str) -> DataFrame:
    """Rows whose key the other table hasn't; a null key is in no table."""
    return df.join(other.select(F.col(other_key).alias(key)), key, "left_anti")


def first_of_equal(df: DataFrame, text: str, order: str) -> DataFrame:
    """(order, copies): of texts that are equal but for case and outer blanks the first, and how many there are; null texts are left out."""
    own = df.where(F.col(text).isNotNull()).select(order, F.md5(F.lower(F.trim(text))).alias("_h"))
    return own.groupBy("_h").agg(F.min(order).alias(order), F.count("*").alias("copies")).drop("_h")


def with_new_day(df: DataFrame, group: list[str], at: str, tie: str) -> DataFrame:
    """``df`` with ``day`` and ``new_day``: the first row of the group on its day, where a date line stands."""
    own = df.withColumn("day", F.to_date(at))
    first = own.groupBy(*group, "day").agg(F.min(F.struct(at, tie)).alias("_f"))
    return own.join(first, [*group, "day"]).withColumn("new_day", F.col(tie) == F.col(f"_f.{tie}")).drop("_f")


def positions(df: DataFrame, group: list[str], at: str, tie: str, out: str) -> DataFrame:
    """``out``: how many rows of the group come before, by time then ``tie``; counted in hours, so groups of any size are safe."""
    return prefix_sums(df.withColumn("_one", F.lit(1)), group, at, "_one", out, F.date_trunc("hour", F.col(at)), [tie]).drop("_one").withColumn(out, F.col(out).cast("bigint"))


def with_next(df: DataFrame, group: list[str], at: str, tie: str, columns: list[str]) -> DataFrame:
    """``df`` with ``next_…`` of each column from the following row of the group; found in hours, then from hour to hour."""
    own = df.withColumn("_block", F.date_trunc("hour", F.col(at)))
    value = F.struct(at, tie, *columns)
    inside = W.partitionBy(*group, "_block").orderBy(at, tie)
    first = own.groupBy(*group, "_block").agg(F.min(value).alias("_first"))
    following = first.select(*group, "_block", F.lead("_first").over(W.partitionBy(*group).orderBy("_block")).alias("_after"))
    both = own.withColumn("_next", F.lead(value).over(inside)).join(following, [*group, "_block"])
    both = both.withColumn("_next", F.coalesce("_next", "_after"))
    return both.select(*df.columns, *(F.col(f"_next.{c}").alias(f"next_{c}") for c in columns))


Strategy = Lookup | TimeSeries | Conversations


def by_table(strategies: list[tuple[str, Strategy]]) -> dict[str, dict[str, Strategy]]:
    """Strategies by table name and own name; a repeated name in a table is an error."""
    out: dict[str, dict[str, Strategy]] = {}
    for table, group in groupby(sorted(strategies, key=lambda x: x[0]), key=lambda x: x[0]):
        for _, s in group:
            if s.name in out.setdefault(table, {}):
                raise ValueError(f"two strategies named {s.name} for table {table}")
            out[table][s.name] = s
    return out


def flat(grouped: dict[str, dict[str, Strategy]]) -> list[tuple[str, Strategy]]:
    """The strategies of ``by_table`` as a list again, by table and name."""
    return [(table, grouped[table][name]) for table in sorted(grouped) for name in sorted(grouped[table])]


def pair_positions(left: int, right: int, most: int, seed: int = 42) -> str:
    """SQL of the flat index of the n-th pair: all pairs in order, or ``most`` distinct ones spread by a seeded step."""
    total = left * right
    if total <= most:
        return "id"
    step = next(s for s in range((seed * 7919) % total | 1, total * 2, 2) if _coprime(s, total))
    return f"(id * {step}L + {seed}L) % {total}L"


def _coprime(a: int, b: int) -> bool:
    while b:
        a, b = b, a % b
    return a == 1


def pairs(left: DataFrame, right: DataFrame, n_left: int, n_right: int, most: int, seed: int = 42) -> DataFrame:
    """All pairs, or ``most`` distinct pairs, of rows numbered from 0 in ``_at``: two equi-joins on positions, no cross join."""
    flat = left.sparkSession.range(min(n_left * n_right, most)).selectExpr(f"{pair_positions(n_left, n_right, most, seed)} AS flat")
    flat = flat.selectExpr(f"flat DIV {max(n_right, 1)} AS i", f"flat % {max(n_right, 1)} AS j")
    left, right = (d.withColumnsRenamed({c: f"{p}_{c}" for c in d.columns if c != "_at"}) for d, p in ((left, "left"), (right, "right")))
    return flat.join(left.withColumnRenamed("_at", "i"), "i").join(right.withColumnRenamed("_at", "j"), "j").drop("i", "j")
