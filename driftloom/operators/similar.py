"""Nearest vectors through an index of lists: every row lies in the list of its nearest centre, a query looks into a few lists.

Centres are fitted on a bounded sample (``SAMPLE_ROWS``); all rows are indexed. A list of any size is searched in blocks of bounded
size, and so are its queries, so a hot list is many small tasks; scores are worked out for ``CELLS`` pairs at a time. Vectors travel
packed. ``simulate.top_similar`` is the exact search to measure recall by.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from driftloom.functions.hashing import portable_hash
from driftloom.session import least_rows

#: Rows the centres are fitted on at most, rounds of the fit, rows of a list and queries to it that meet in one task.
SAMPLE_ROWS, FIT_ROUNDS, BLOCK_ROWS = 20_000, 12, 8192

#: Scores a task holds at a time.
CELLS = 1 << 20

#: More than two scores of unit vectors may be off in single precision, together.
_COARSE = 1e-4


def _unit(m: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, norm, out=np.zeros_like(m), where=norm > 0)


def usable(df: DataFrame, key: str, vector: str) -> DataFrame:
    """(key, vector): rows with a vector other than zeros."""
    rows = df.select(F.col(key).cast("long").alias("key"), F.col(vector).cast("array<double>").alias("vector"))
    return rows.where("key IS NOT NULL AND vector IS NOT NULL AND exists(vector, x -> x <> 0)")


def fit_centres(base: DataFrame, key: str, vector: str, lists: int, seed: int = 42) -> np.ndarray:
    """Unit vectors of at most ``lists`` centres, by k-means on directions of a sample of the least hashes."""
    sample = least_rows(usable(base, key, vector).withColumn("_h", portable_hash(F.col("key"), seed)), "_h", "key", SAMPLE_ROWS).orderBy("_h", "key").collect()
    return centres_of(np.array([r["vector"] for r in sample]) if sample else np.zeros((0, 0)), lists)


def centres_of(sample: np.ndarray, lists: int) -> np.ndarray:
    """Centres of the rows of a sample, the first of which are the centres to begin with."""
    m = _unit(sample)
    centres = m[: min(lists, len(m))].copy()
    for _ in range(FIT_ROUNDS if len(m) else 0):
        own = (m @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, m)
        centres = np.where(np.linalg.norm(sums, axis=1, keepdims=True) > 0, _unit(sums), centres)
    return centres


def _stacked(vectors: pd.Series) -> np.ndarray:
    return np.stack(vectors.to_numpy())


def pack(m: np.ndarray) -> list[bytes]:
    """Each row of a matrix in few bytes, exactly: small counts or numbers at the places that aren't zero, or all numbers where that is shorter."""
    place = np.min_scalar_type(max(m.shape[1] - 1, 0))
    counts = ((m >= 0) & (m <= 255) & (m == np.rint(m))).all(axis=1)
    rows, places = np.nonzero(m)
    values, ends = m[rows, places], np.searchsorted(rows, np.arange(len(m) + 1))
    places, small = places.astype(place), np.where(counts[rows], values, 0).astype("uint8")
    out = []
    for i, (a, b) in enumerate(zip(ends[:-1], ends[1:])):
        if counts[i]:
            out.append(b"c" + places[a:b].tobytes() + small[a:b].tobytes())
        elif (b - a) * (place.itemsize + 8) < m.shape[1] * 8:
            out.append(b"s" + places[a:b].tobytes() + values[a:b].tobytes())
        else:
            out.append(b"a" + m[i].tobytes())
    return out


def unpack(packed: Sequence[bytes], width: int) -> np.ndarray:
    """The matrix that was packed."""
    m, place = np.zeros((len(packed), width)), np.min_scalar_type(max(width - 1, 0))
    for i, x in enumerate(packed):
        if x[:1] == b"a":
            m[i] = np.frombuffer(x, "float64", offset=1)
            continue
        value = np.dtype("uint8" if x[:1] == b"c" else "float64")
        n = (len(x) - 1) // (place.itemsize + value.itemsize)
        m[i, np.frombuffer(x, place, n, 1)] = np.frombuffer(x, value, n, 1 + n * place.itemsize)
    return m


def _listed(df: DataFrame, key: str, vector: str, centres: np.ndarray, most: int, matrix: Callable[[pd.Series], np.ndarray] | None, keep: Sequence[str] = ()) -> DataFrame:
    """(list, key, vector, …): every row in the lists of its ``most`` nearest centres, its vector packed.

    ``matrix`` makes vectors of a column of something else, such as texts; rows with a vector of zeros are left out.
    """
    make = matrix or _stacked

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf):
                continue
            m = make(pdf["vector"])
            some = m.any(axis=1)
            m, pdf = m[some], pdf[some]
            # rounded, so that the same vector has the same lists in any batch
            lists = np.argsort(-np.round(_unit(m) @ centres.T, 9), axis=1, kind="stable")[:, :most]
            again = np.repeat(np.arange(len(m)), lists.shape[1])
            packed = np.empty(len(m), dtype=object)
            packed[:] = pack(m)
            yield pd.DataFrame({"list": lists.ravel().astype("int32"), "key": pdf["key"].to_numpy()[again], "vector": packed[again]} | {c: pdf[c].to_numpy()[again] for c in keep})

    own = df if matrix is not None else df.withColumn(vector, F.col(vector).cast("array<double>"))
    rows = own.select(F.col(key).cast("long").alias("key"), F.col(vector).alias("vector"), *keep).where("key IS NOT NULL AND vector IS NOT NULL")
    return rows.mapInPandas(run, ", ".join(["list int, key long, vector binary", *(f"{c} {t}" for c, t in df.select(*keep).dtypes)]))


def index(base: DataFrame, key: str, vector: str, centres: np.ndarray, matrix: Callable[[pd.Series], np.ndarray] | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """(list, key, vector, …): every row in the list of its nearest centre, with the columns of ``keep``."""
    return _listed(base, key, vector, centres, 1, matrix, keep)


def _best(a: np.ndarray, ids: np.ndarray, b: np.ndarray, names: np.ndarray, k: int) -> pd.DataFrame:
    """(query, key, score): the ``k`` best rows of ``a`` for each row of ``b``, by score rounded to nine digits, ties by key."""
    found = [(np.zeros(0, "int64"), np.zeros(0, "int64"), np.zeros(0))]
    rows, asking, numbers = a.astype("float32"), b.astype("float32"), np.isfinite(a).all() and np.isfinite(b).all()
    step = max(1, CELLS // max(1, len(a)))
    for at in range(0, len(b) if len(a) else 0, step):
        s = asking[at : at + step] @ rows.T
        if not numbers:
            s[np.isnan(s)] = -np.inf
        worst = s.max(axis=1) if k == 1 else np.partition(s, -k, axis=1)[:, -k] if k < len(a) else s.min(axis=1)
        q, r = np.nonzero(s >= worst[:, None] - _COARSE)  # all that may be among them by the exact scores
        score = np.concatenate([np.einsum("ij,ij->i", b[at + q[i : i + piece]], a[r[i : i + piece]]) for piece in [max(1, CELLS // a.shape[1])] for i in range(0, len(q), piece)])
        score = np.round(np.where(np.isnan(score), -np.inf, score), 9)
        order = np.lexsort((ids[r], -score, q))
        q, r, score = q[order], r[order], score[order]
        first = np.arange(len(q)) - np.searchsorted(q, q) < k
        found.append((names[at + q[first]], ids[r[first]], np.where(np.isneginf(score[first]), np.nan, score[first])))
    query, key, score = (np.concatenate(x) for x in zip(*found))
    return pd.DataFrame({"query": query, "key": key, "score": score})


def search(indexed: DataFrame, queries: DataFrame, key: str, vector: str, centres: np.ndarray, k: int, probes: int, matrix: Callable[[pd.Series], np.ndarray] | None = None) -> DataFrame:
    """(query, key, score): of each query the ``k`` most similar rows of its ``probes`` nearest lists, by cosine, ties by key."""
    spark = indexed.sparkSession
    if not len(centres):
        return spark.createDataFrame([], "query long, key long, score double")
    asked = _listed(queries, key, vector, centres, min(probes, len(centres)), matrix)
    indexed = indexed.select("list", "key", "vector")
    blocks = [_blocks(d) for d in (indexed, asked)]
    number = lambda counts: F.element_at(F.array(*(F.lit(counts.get(i, 1)) for i in range(len(centres)))), F.col("list") + 1)
    own = lambda d, counts: F.pmod(F.xxhash64("key"), number(counts)).cast("int")
    every = lambda counts: F.explode(F.sequence(F.lit(0), number(counts) - 1))
    rows = indexed.withColumn("block", own(indexed, blocks[0])).withColumn("part", every(blocks[1]))
    asking = asked.withColumn("part", own(asked, blocks[1])).withColumn("block", every(blocks[0]))
    width = centres.shape[1]

    def best(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        own, asking = (_unit(unpack(d["vector"], width)) if len(a) and len(b) else np.zeros((0, width)) for d in (a, b))
        return _best(own, a["key"].to_numpy(), asking, b["key"].to_numpy(), k)

    keys = ["list", "block", "part"]
    found = rows.groupBy(*keys).cogroup(asking.groupBy(*keys)).applyInPandas(best, "query long, key long, score double")
    place = F.row_number().over(W.partitionBy("query").orderBy(F.desc("score"), "key"))
    return found.withColumn("_r", place).where(F.col("_r") <= k).drop("_r")


def _blocks(rows: DataFrame) -> dict[int, int]:
    """Blocks of each list."""
    return {r["list"]: -(-r["n"] // BLOCK_ROWS) for r in rows.groupBy("list").agg(F.count("*").alias("n")).collect()}  # a row per centre


def top_similar(base: DataFrame, queries: DataFrame, key: str, vector: str, k: int, keep: Column | None = None, lists: int = 64, probes: int = 16) -> DataFrame:
    """Index and search in one; the filter goes first."""
    kept = base.where(keep) if keep is not None else base
    centres = fit_centres(kept, key, vector, lists)
    return search(index(kept, key, vector, centres) if len(centres) else usable(kept, key, vector).withColumn("list", F.lit(0)), queries, key, vector, centres, k, probes)


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """One row (queries, recall): the share of the exact hits that were found."""
    return exact.join(found.select("query", "key", F.lit(1).alias("_hit")), ["query", "key"], "left").agg(F.count_distinct("query").alias("queries"), (F.count("_hit") / F.count("*")).alias("recall"))
