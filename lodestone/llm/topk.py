"""Exact top-k inner products from impact-ordered indexes.

Distinct vectors are dealt into blocks. In a block each dimension has a posting list in descending
quantised impact; a query adds up posting segments in descending order of query weight times impact
and stops a candidate only on proof: its unseen part is bounded by the unseen squares. Candidates that may still belong are scored exactly.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.operators.skew import salted_join, top_rows
from lodestone.session import cut_lineage

BLOCK_ROWS = 8192
QUERY_ROWS = 512
LEVELS = 16
# Parts of a block's postings after which the proof is tried.
STOPS = (0.25, 0.45, 0.65, 1.0)


def padded(rows: list, width: int | None = None) -> np.ndarray:
    """Rows of integers of any lengths as one matrix; missing components are 0."""
    width = max([len(row) for row in rows] + [width or 0])
    grid = np.zeros((len(rows), width), dtype=np.int64)
    for place, row in enumerate(rows):
        grid[place, : len(row)] = row
    return grid


class ImpactIndex:
    """Posting lists of one block: rows, signed components and segment ends, in descending quantised impact."""

    def __init__(self, vectors: np.ndarray) -> None:
        self.vectors = vectors
        count, width = vectors.shape
        impact = np.abs(vectors)
        self.shift = max(0, int(impact.max(initial=0)).bit_length() - 4)
        level = (impact >> self.shift).astype(np.int8)
        order = np.argsort(-level, axis=0, kind="stable")
        self.rows = np.ascontiguousarray(order.T)
        self.values = np.ascontiguousarray(np.take_along_axis(vectors, order, axis=0).T.astype(np.float64))
        # Of each dimension: how many postings lie at a level or above, from the highest level down.
        self.ends = np.stack([(level >= LEVELS - 1 - i).sum(axis=0) for i in range(LEVELS)], axis=1).reshape(width, LEVELS)
        self.most = ((np.arange(LEVELS - 1, -1, -1) + 1) << self.shift) - 1.0
        self.norms = (vectors.astype(np.float64) ** 2).sum(axis=1)

    def search(self, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows that are surely all of the block's ``k`` best, ties included, and their exact scores."""
        count, width = self.vectors.shape
        wide = np.zeros(width)
        wide[: min(width, len(query))] = query[:width]
        score = lambda rows: self.vectors[rows] @ wide.astype(np.int64)
        if count <= 4 * k or not width:
            everything = np.arange(count)
            return everything, score(everything)
        bound = np.abs(wide)[:, None] * self.most
        sizes = np.diff(self.ends, axis=1, prepend=0)
        order = np.argsort(-bound, axis=None, kind="stable")
        upto = np.cumsum(sizes.reshape(-1)[order])
        # An unseen part q * v is at most (s * q) ** 2 / 2 + (v / s) ** 2 / 2, so what is seen takes half of
        # (s * q - v / s) ** 2 off the highest score that a row can have; s evens out the norms.
        even = ((self.norms.mean() + 1) / (wide @ wide + 1)) ** 0.25
        highest = (even * even * (wide @ wide) + self.norms / (even * even)) / 2
        # Rounding of sums of ``width`` such squares, and of the comparison with an integer score.
        slack = 1 + 8 * (width + 2) * np.finfo(np.float64).eps * (2 * highest)
        done, total = np.zeros(width, dtype=np.int64), count * width
        for stop in STOPS:
            segments = order[: int(np.searchsorted(upto, stop * total)) + 1]
            ends = np.bincount(segments // LEVELS, weights=sizes.reshape(-1)[segments], minlength=width).astype(np.int64)
            parts = [(i, done[i], ends[i]) for i in np.flatnonzero(ends > done)]
            if parts:
                gap = np.concatenate([self.values[i, a:b] for i, a, b in parts])
                gap *= -1 / even
                gap += np.repeat(np.array([wide[i] * even for i, _, _ in parts]), [b - a for _, a, b in parts])
                gap *= gap
                highest -= np.bincount(np.concatenate([self.rows[i, a:b] for i, a, b in parts]), weights=gap, minlength=count) / 2
            done = ends
            likely = np.argpartition(-highest, 4 * k)[: 4 * k]
            least = np.partition(score(likely), -k)[-k]
            possible = np.flatnonzero(highest + slack >= least)
            if len(possible) <= max(8 * k, count // 16) or stop == STOPS[-1]:
                return possible, score(possible)
        raise AssertionError("the last stop returns")


def quantised(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """vec_id and ``vec``, floor(scale * x) of each component; rows without an id, or with a null or non-finite component, are left out."""
    finite = "forall(embedding, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < CAST('Infinity' AS DOUBLE))"
    whole = f"transform(embedding, x -> CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS vec"
    return vectors.where(f"vec_id IS NOT NULL AND embedding IS NOT NULL AND {finite}").selectExpr("vec_id", whole).distinct()


def _packed(rows: DataFrame, group: str, columns: list[str], block_rows: int) -> DataFrame:
    """``rows`` dealt by the hash of ``vec`` into near-equal groups, one binary row each."""
    groups = -(-rows.count() // block_rows) or 1

    def store(frame: pd.DataFrame) -> pd.DataFrame:
        held = io.BytesIO()
        frame = frame.sort_values(columns[0], key=lambda column: column.map(lambda v: v[0] if isinstance(v, np.ndarray) else v))
        if "ids" in columns:
            width = max(map(len, frame["ids"]))
            ids = np.array([[*row, *[-1] * (width - len(row))] for row in frame["ids"]], dtype=np.int64)
            np.savez(held, vectors=padded(list(frame["vec"])), ids=ids, counts=np.array([len(row) for row in frame["ids"]]))
        else:
            np.savez(held, vectors=padded(list(frame["vec"])), rep=frame["rep"].to_numpy(dtype=np.int64))
        return pd.DataFrame({group: [int(frame["__g"].iloc[0])], f"{group}_data": [held.getvalue()]})

    dealt = rows.select(*columns, "vec", F.pmod(F.xxhash64("vec"), F.lit(groups)).cast("int").alias("__g"))
    return cut_lineage(dealt.groupBy("__g").applyInPandas(store, f"{group} int, {group}_data binary"))


def nearest(vectors: DataFrame, k: int = 5, every: int = 50) -> DataFrame:
    """The ``k`` rows with the highest integer inner product for each query, a row whose vec_id is divisible by ``every``.

    ``vectors`` has vec_id (long) and embedding; see ``quantised`` for rows that take no part. A row
    with the query's id is the query's own. Ties go to the smaller vec_id; with fewer candidates all
    are returned. Repeated rows count once; of components that only the longer of two vectors has,
    the product is 0. Equal vectors are scored once: of each only the smallest ids can be needed.
    Returns query_id, rank, vec_id and score. Other columns are not read.
    """
    rows = cut_lineage(quantised(vectors))
    queries = rows.where(F.col("vec_id") % every == 0)
    own = queries.groupBy("vec_id").count().agg(F.max("count")).first()[0]
    if own is None:
        return rows.select(F.col("vec_id").alias("query_id"), F.lit(0).alias("rank"), "vec_id", F.lit(0).cast("long").alias("score")).limit(0)
    keep = k + own
    distinct = top_rows(rows, ["vec"], [F.col("vec_id")], keep).groupBy("vec").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    asked = queries.groupBy("vec").agg(F.min("vec_id").alias("rep"))
    index, questions = _packed(distinct, "block", ["ids"], BLOCK_ROWS), _packed(asked, "part", ["rep"], QUERY_ROWS)
    blocks, parts = ([row[0] for row in frame.select(name).collect()] for frame, name in ((index, "block"), (questions, "part")))
    pairs = index.withColumn("part", F.explode(F.lit(parts))).join(
        questions.withColumn("block", F.explode(F.lit(blocks))), ["block", "part"]
    ).select("block_data", "part_data")

    def search(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for stored, asked_for in zip(frame["block_data"], frame["part_data"], strict=True):
                block, part = np.load(io.BytesIO(stored)), np.load(io.BytesIO(asked_for))
                index, ids, counts = ImpactIndex(block["vectors"]), block["ids"], block["counts"]
                reps, members, scores = [], [], []
                for rep, query in zip(part["rep"], part["vectors"], strict=True):
                    found, value = index.search(query, keep)
                    place = np.repeat(np.arange(len(found)), counts[found])
                    member = ids[found][np.arange(ids.shape[1]) < counts[found][:, None]]
                    best = np.lexsort((member, -value[place]))[:keep]
                    reps.append(np.full(len(best), rep))
                    members.append(member[best])
                    scores.append(value[place][best])
                yield pd.DataFrame({"rep": np.concatenate(reps), "vec_id": np.concatenate(members), "score": np.concatenate(scores)})

    found = pairs.repartition(max(1, min(len(blocks) * len(parts), 100_000))).mapInPandas(search, "rep long, vec_id long, score long")
    order = [F.col("score").desc(), F.col("vec_id")]
    best = top_rows(found, ["rep"], order, keep)
    named = salted_join(queries.withColumnRenamed("vec_id", "query_id"), asked, ["vec"]).select("query_id", "rep")
    answers = named.join(best, "rep").where("query_id <> vec_id")
    return top_rows(answers, ["query_id"], order, k, "rank").select("query_id", "rank", "vec_id", "score")
