"""Exact top-k by inner product over vector-approximation files.

Candidates are dealt into groups of a few thousand. A group's file holds, for every position, marks at the quantiles of its own
values, and for every vector the numbers of the cells its components fall into (a byte each) next to the exact components. A scan
of the cells bounds every score from both sides. Round one keeps each query's k highest lower bounds a group; the k-th of them
over all groups is what a candidate has to reach. Round two takes, group by group, the candidates whose upper bound reaches it in
the order of that bound and reads their exact vectors until no bound left can beat the k-th score found.

Queries meet candidates as blocks on a grid: both sides are dealt by hash, so no task holds more than one block of each, and a
task returns at most k rows a query. Nothing is broadcast. Of equal vectors only the k+1 first ids can be among anyone's k best,
so the others are left out of the files (a rank that is cut before the shuffle), however many there are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sitefit.llm.vectors import integer_vectors, matrix, widened
from sitefit.session import cut

#: Vectors of a group and queries of a block.
GROUP_ROWS, QUERY_ROWS = 8192, 2048
#: Cells a position.
CELLS = 64
#: Exact vectors read at a time, and queries bounded at a time; no result depends on them.
READ, AT_ONCE = 64, 128
#: Stands for a missing id; sorts last.
NO_ID = np.iinfo(np.int64).max

_FILE = "grp int, n int, width int, row binary, vec_id binary, marks binary, cells binary, exact binary"
_BLOCK = "block int, n int, width int, row binary, reach binary, exact binary"
_BOUND = pa.schema([("row", pa.int64()), ("bound", pa.float64())])
_FOUND = pa.schema([("row", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])


def top_k(vectors: DataFrame, k: int = 5, scale: int = 256, every: int = 50) -> DataFrame:
    """The k highest inner products of each query row with the other rows, of components floor(scale * x).

    Queries are the rows whose `vec_id` is divisible by `every`. Result: query_id, rank (int, from 1), vec_id, score; ties go to
    the smaller vec_id. Rows whose vector is null or holds null or non-finite components take no part. A repeated row is a
    candidate (also of its copies) and a query as often as it stands there. Rows without an id are candidates only and come last
    among ties. Vectors of unequal lengths are compared as if filled up with zeros. With fewer than k candidates all are
    returned; an empty table gives none. Other columns are not read.
    """
    rows = cut(integer_vectors(vectors, scale))
    queries = rows.filter(F.col("vec_id") % every == 0)
    first = W.partitionBy("v").orderBy(F.col("vec_id").asc_nulls_last(), "row")
    candidates = rows.withColumn("copy", F.row_number().over(first)).filter(F.col("copy") <= k + 1).drop("copy")
    n, asked = rows.count(), queries.count()
    groups, blocks = -(-n // GROUP_ROWS) or 1, -(-asked // QUERY_ROWS) or 1

    files = cut(candidates.withColumn("grp", F.pmod(F.xxhash64("row"), F.lit(groups)).cast("int")).groupBy("grp").applyInArrow(_file, _FILE))
    spread = files.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def met(asking: DataFrame, read: tuple[str, ...], work, schema: pa.Schema) -> DataFrame:
        packed = asking.withColumn("block", F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int")).groupBy("block").applyInArrow(_block, _BLOCK)
        grid = packed.withColumn("grp", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
        kinds = ", ".join(f"{f.name} {'long' if f.type == pa.int64() else 'double'}" for f in schema)
        left = spread.select("block", "grp", "n", "width", "row", "marks", "cells", *read)
        return left.groupBy("block", "grp").cogroup(grid.groupBy("block", "grp")).applyInArrow(lambda a, b: work(k, a, b), kinds)

    bounds = met(queries.withColumn("reach", F.lit(-float("inf"))), (), _bounds, _BOUND)
    nth = F.row_number().over(W.partitionBy("row").orderBy(F.col("bound").desc()))
    reach = bounds.withColumn("nth", nth).filter(F.col("nth") <= k).filter(F.col("nth") == k).select("row", F.col("bound").alias("reach"))
    asking = queries.join(reach, "row", "left").withColumn("reach", F.coalesce("reach", F.lit(-float("inf"))))
    found = met(asking, ("vec_id", "exact"), _refined, _FOUND)
    best = F.row_number().over(W.partitionBy("row").orderBy(F.col("score").desc(), F.col("vec_id")))
    ranked = found.withColumn("rank", best).filter(F.col("rank") <= k)
    ids = queries.select("row", F.col("vec_id").alias("query_id"))
    return ranked.join(ids, "row").select("query_id", F.col("rank").cast("int").alias("rank"), F.when(F.col("vec_id") != int(NO_ID), F.col("vec_id")).alias("vec_id"), "score")


def _row(schema: str, *values) -> pa.Table:
    kinds = {"int": pa.int32(), "binary": pa.binary()}
    fields = [(name, kinds[kind]) for name, kind in (part.split() for part in schema.split(","))]
    return pa.table([pa.array([x], t) for x, (_, t) in zip(values, fields, strict=True)], schema=pa.schema(fields))


def _file(key: tuple, group: pa.Table) -> pa.Table:
    """A group's vector-approximation file: marks, cells, exact components."""
    exact = matrix(group["v"])
    n, width = exact.shape
    at = np.unique(np.linspace(0, n - 1, CELLS + 1).round().astype(int))
    marks = np.sort(exact, axis=0)[at] if width else np.zeros((len(at), 0), np.int32)
    cells = np.empty((n, width), np.uint8)
    for j in range(width):
        cells[:, j] = np.clip(np.searchsorted(marks[:, j], exact[:, j], "right") - 1, 0, max(len(at) - 2, 0))
    ids = group["vec_id"].fill_null(NO_ID).to_numpy()
    return _row(_FILE, key[0].as_py(), n, width, group["row"].to_numpy().tobytes(), ids.tobytes(), marks.astype(np.int32).tobytes(), cells.tobytes(), exact.tobytes())


def _block(key: tuple, group: pa.Table) -> pa.Table:
    exact = matrix(group["v"])
    return _row(_BLOCK, key[0].as_py(), *exact.shape, group["row"].to_numpy().tobytes(), group["reach"].to_numpy().tobytes(), exact.tobytes())


def _pairs(a: pa.Table, b: pa.Table) -> Iterator[tuple]:
    """For some queries at a time: their numbers and vectors, the file's rows, lower and upper bounds (candidates x queries).

    A score lies between the sums of what the lower and upper ends of the cells give. The bounds are sums of whole numbers in
    doubles, exact up to 2**53; beyond that they are widened by more than rounding can take.
    """
    if not a.num_rows or not b.num_rows:
        return
    (f,), (q,) = a.to_pylist(), b.to_pylist()
    width = max(f["width"], q["width"])
    marks = np.frombuffer(f["marks"], np.int32).reshape(-1, f["width"]) if f["width"] else np.zeros((1, 0), np.int32)
    cells = np.frombuffer(f["cells"], np.uint8).reshape(f["n"], f["width"])
    at = np.arange(f["width"])
    low = widened(marks[cells, at].astype(np.float64), width)
    high = widened(marks[np.minimum(cells + 1, len(marks) - 1), at].astype(np.float64), width)
    asked = widened(np.frombuffer(q["exact"], np.int32).reshape(q["n"], q["width"]), width)
    rows, numbers, reach = (np.frombuffer(x, t) for x, t in ((f["row"], np.int64), (q["row"], np.int64), (q["reach"], np.float64)))
    for s in range(0, len(asked), AT_ONCE):
        some = asked[s : s + AT_ONCE]
        up, down = np.maximum(some, 0).T.astype(np.float64), np.maximum(-some.astype(np.int64), 0).T.astype(np.float64)
        lower, upper = low @ up - high @ down, high @ up - low @ down
        most = np.maximum(np.abs(low), np.abs(high)).max(initial=0) * np.abs(some.astype(np.int64)).max(initial=0) * width
        if most >= 2**52:
            lower, upper = lower - most * 1e-12, upper + most * 1e-12
        own = rows[:, None] == numbers[s : s + AT_ONCE]
        lower[own], upper[own] = -np.inf, -np.inf
        yield f, numbers[s : s + AT_ONCE], some, reach[s : s + AT_ONCE], rows, lower, upper


def _bounds(k: int, a: pa.Table, b: pa.Table) -> pa.Table:
    """Each query's k highest lower bounds in the group."""
    out = []
    for _, numbers, _, _, rows, lower, _ in _pairs(a, b):
        best = np.sort(np.partition(lower, len(rows) - k, axis=0)[-k:] if len(rows) > k else lower, axis=0)
        of, bound = np.broadcast_to(numbers, best.shape).ravel(), best.ravel()
        out.append(pa.table([of[bound > -np.inf], bound[bound > -np.inf]], schema=_BOUND))
    return pa.concat_tables(out) if out else _BOUND.empty_table()


def _refined(k: int, a: pa.Table, b: pa.Table) -> pa.Table:
    """Each query's k best of the group, reading exact vectors in the order of their upper bounds until these are certain."""
    out = []
    for f, numbers, some, reach, rows, _, upper in _pairs(a, b):
        exact = np.frombuffer(f["exact"], np.int32).reshape(f["n"], f["width"])
        ids = np.frombuffer(f["vec_id"], np.int64)
        for j, number in enumerate(numbers):
            left = np.flatnonzero((upper[:, j] >= reach[j]) & (rows != number))
            left = left[np.argsort(-upper[left, j], kind="stable")]
            query, at, scores, best = some[j, : exact.shape[1]].astype(np.int64), 0, np.zeros(0, np.int64), -np.inf
            while at < len(left) and upper[left[at], j] >= best:
                scores = np.concatenate([scores, exact[left[at : at + READ]].astype(np.int64) @ query])
                at = len(scores)
                if at >= k:
                    best = np.partition(scores, at - k)[at - k]
            read = left[:at]
            top = np.lexsort((ids[read], -scores))[:k]
            out.append((np.full(len(top), number), ids[read[top]], scores[top]))
    if not out:
        return _FOUND.empty_table()
    return pa.table([np.concatenate(c) for c in zip(*out, strict=True)], schema=_FOUND)
