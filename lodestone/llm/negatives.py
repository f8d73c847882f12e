"""Hard negatives by coordinate pruning over length buckets.

Candidates lie in buckets of one label and of similar length. A bucket holds, for every coordinate,
its unit vectors in the order of that coordinate. To reach a score, a candidate's angle to the
anchor must be small, which bounds each of its coordinates: on the anchor's largest (focus)
coordinates these ranges are looked up in the sorted lists, the candidate sets are intersected, and
what is left is scored exactly in integers. Buckets too short to reach the score are passed over.

Anchors of one label are dealt into parts and buckets into runs; a part meets each run in one stream,
longest buckets first, so that the scores found narrow the search in the buckets that follow.
"""

from __future__ import annotations

import io
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.operators.skew import spread_join, top_rows
from lodestone.session import cut_lineage

BUCKET_ROWS = 4096
BUCKET_BYTES = 8_000_000
PART_ROWS = 2048
RUN_BUCKETS = 64
FOCUS = 6
# Angles and norms are rounded; feasible ranges are wider by this much.
SLACK = 1e-7


def finite_vectors(vectors: DataFrame, label: Column, scale: int = 256) -> DataFrame:
    """vec_id, label and ``vec``, floor(scale * x) of each component; rows with a null id or label, or a null or non-finite component, are left out.

    Equal rows count once.
    """
    sound = "vec_id IS NOT NULL AND embedding IS NOT NULL AND forall(embedding, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < CAST('Infinity' AS DOUBLE))"
    whole = F.expr(f"transform(embedding, x -> CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT))")
    return vectors.where(sound).select("vec_id", label.alias("label"), whole.alias("vec")).where(F.col("label").isNotNull()).distinct()


def matrix(rows: list[np.ndarray], width: int) -> np.ndarray:
    """Integer vectors of any lengths as one matrix; missing components are 0."""
    grid = np.zeros((len(rows), width), dtype=np.int64)
    for place, row in enumerate(rows):
        grid[place, : len(row)] = row
    return grid


def packed(**arrays: np.ndarray) -> bytes:
    """Arrays as bytes, integers as narrow as their values allow."""
    held = io.BytesIO()
    for name, values in arrays.items():
        low, high = values.min(initial=0), values.max(initial=0)
        arrays[name] = values.astype(next(kind for kind in (np.int8, np.int16, np.int32, np.int64) if np.iinfo(kind).min <= low and high <= np.iinfo(kind).max))
    np.savez(held, **arrays)
    return held.getvalue()


class Bucket:
    """Vectors of one label and similar length, with one sorted list for each coordinate."""

    def __init__(self, vectors: np.ndarray, ids: np.ndarray) -> None:
        self.vectors, self.ids = vectors, ids
        norms = np.sqrt((vectors.astype(np.float64) ** 2).sum(axis=1))
        self.longest = float(norms.max(initial=0.0))
        self.unit = (vectors / np.where(norms > 0, norms, 1)[:, None]).T.copy()
        self.order = np.argsort(self.unit, axis=1, kind="stable")
        self.lists = np.take_along_axis(self.unit, self.order, axis=1)

    def candidates(self, anchor: np.ndarray, length: float, least: float, focus: int = FOCUS) -> np.ndarray:
        """Rows of the bucket that may reach the score ``least`` with ``anchor`` (floats, of this length); all others surely do not."""
        everything = np.arange(len(self.ids))
        if least <= 0 or not length:
            # Half the sphere or more can reach it: no range is narrow enough to help.
            return everything if least <= 0 else everything[:0]
        cosine = least / (length * self.longest) if self.longest else np.inf
        if cosine > 1 + SLACK:
            return everything[:0]
        turn = np.arccos(min(1.0, cosine))
        places = np.argsort(-np.abs(anchor), kind="stable")[:focus]
        angle = np.arccos(np.clip(anchor[places] / length, -1, 1))
        low, high = np.cos(np.minimum(np.pi, angle + turn)) - SLACK, np.cos(np.maximum(0.0, angle - turn)) + SLACK
        starts = [int(self.lists[i].searchsorted(value, "left")) for i, value in zip(places, low, strict=True)]
        ends = [int(self.lists[i].searchsorted(value, "right")) for i, value in zip(places, high, strict=True)]
        narrow = int(np.argmin(np.array(ends) - np.array(starts)))
        rows = self.order[places[narrow], starts[narrow] : ends[narrow]]
        for nth, i in enumerate(places):
            if nth != narrow and len(rows):
                values = self.unit[i, rows]
                rows = rows[(values >= low[nth]) & (values <= high[nth])]
        return rows


@dataclass
class Best:
    """The ``k`` highest (score, smallest id) rows seen so far that lie in a window of scores."""

    k: int
    least: float
    most: float
    scores: np.ndarray
    ids: np.ndarray
    own: np.ndarray

    @classmethod
    def empty(cls, k: int, least: float = -np.inf, most: float = np.inf) -> Best:
        return cls(k, least, most, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool))

    @property
    def bound(self) -> float:
        """Rows of a lower score are not wanted."""
        return max(self.least, self.scores[-1]) if len(self.scores) >= self.k else self.least

    def offer(self, scores: np.ndarray, ids: np.ndarray, own: np.ndarray) -> None:
        fit = (scores >= self.bound) & (scores <= self.most)
        if fit.any():
            scores, ids, own = np.append(self.scores, scores[fit]), np.append(self.ids, ids[fit]), np.append(self.own, own[fit])
            first = np.lexsort((ids, -scores))[: self.k]
            self.scores, self.ids, self.own = scores[first], ids[first], own[first]


def search(bucket: Bucket, anchor: np.ndarray, wanted: list[Best]) -> None:
    """Offer the rows of ``bucket`` to all of ``wanted``; ids of one vector are its smallest, padded with -1."""
    wide = np.zeros(bucket.vectors.shape[1], dtype=np.int64)
    wide[: min(len(wide), len(anchor))] = anchor[: len(wide)]
    length = float(np.sqrt((anchor.astype(np.float64) ** 2).sum()))
    rows = bucket.candidates(wide.astype(np.float64), length, min(best.bound for best in wanted))
    if not len(rows):
        return
    scores = bucket.vectors[rows] @ wide
    own = scores == int(anchor @ anchor)
    if own.any():
        same = np.zeros(max(len(anchor), len(wide)), dtype=np.int64)
        same[: len(anchor)] = anchor
        own &= (bucket.vectors[rows] == wide).all(axis=1) & (not same[len(wide) :].any())
    for best in wanted:
        some = (scores >= best.bound) & (scores <= best.most)
        if some.any():
            ids = bucket.ids[rows[some]]
            held = ids >= 0
            best.offer(np.repeat(scores[some], held.sum(axis=1)), ids[held], np.repeat(own[some], held.sum(axis=1)))


def length_buckets(distinct: DataFrame) -> DataFrame:
    """``distinct`` (label, vec, ids) as rows label, bucket, norm (of the longest), data: near-equal numbers of rows of one label, by length."""
    norm = F.aggregate("vec", F.lit(0.0), lambda total, x: total + x.cast("double") * x.cast("double"))
    count = distinct.count()
    parts = max(1, min(20_000, -(-count // BUCKET_ROWS)))

    def store(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        context = TaskContext.get()
        name, nth = f"{context.partitionId() if context else 0}", 0
        held: list[tuple] = []
        label, width = None, 0

        def flushed() -> pd.DataFrame:
            most = max(len(ids) for _, ids in held)
            ids = np.array([[*row, *[-1] * (most - len(row))] for _, row in held], dtype=np.int64)
            vectors = matrix([vec for vec, _ in held], width)
            longest = float(np.sqrt((vectors.astype(np.float64) ** 2).sum(axis=1)).max())
            return pd.DataFrame({"label": [label], "bucket": [f"{name}-{nth}"], "norm": [longest], "data": [packed(vectors=vectors, ids=ids)]})

        for frame in frames:
            for own, vec, ids in zip(frame["label"], frame["vec"], frame["ids"], strict=True):
                if held and (own != label or len(held) >= BUCKET_ROWS or 8 * (len(held) + 1) * max(width, len(vec)) > BUCKET_BYTES):
                    yield flushed()
                    held, width, nth = [], 0, nth + 1
                label, width = own, max(width, len(vec))
                held.append((vec, ids))
        if held:
            yield flushed()

    # The hash parts vectors of one label and length, so no range is hotter than another.
    keys = [F.col("label"), F.col("__norm").desc(), F.xxhash64("vec")]
    ranged = distinct.withColumn("__norm", norm).repartitionByRange(parts, *keys).sortWithinPartitions(*keys).select("label", "vec", "ids")
    return cut_lineage(ranged.mapInPandas(store, f"label {distinct.schema['label'].dataType.simpleString()}, bucket string, norm double, data binary"))


def anchor_parts(anchors: DataFrame) -> tuple[DataFrame, int]:
    """``anchors`` (label, rep, hash, vec, bounds) as rows label, part, data, and the number of parts; one label's parts have neighbouring numbers.

    ``bounds`` are the scores whose windows are searched, or null.
    """
    sizes = anchors.groupBy("label").count().select("label", F.ceil(F.col("count") / PART_ROWS).cast("long").alias("__parts"))
    line = Window.orderBy("label").rowsBetween(Window.unboundedPreceding, -1)  # one row a label
    sizes = cut_lineage(sizes.withColumn("__first", F.coalesce(F.sum("__parts").over(line), F.lit(0))))
    total = sizes.agg(F.sum("__parts")).first()[0] or 0

    def store(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["rep", "hash"])
        bounds = [np.asarray(row if row is not None else [], dtype=np.int64) for row in frame["bounds"]]
        arrays = {
            "vectors": matrix(list(frame["vec"]), max(map(len, frame["vec"]))), "rep": frame["rep"].to_numpy(np.int64), "hash": frame["hash"].to_numpy(np.int64),
            "bounds": np.concatenate(bounds) if bounds else np.zeros(0, np.int64), "held": np.array([len(row) for row in bounds], dtype=np.int64),
        }
        return pd.DataFrame({"label": [frame["label"].iloc[0]], "part": [int(frame["part"].iloc[0])], "data": [packed(**arrays)]})

    numbered = spread_join(anchors, sizes, ["label"]).withColumn("part", F.col("__first") + F.pmod(F.xxhash64("rep", "hash"), F.col("__parts")))
    kind = anchors.schema["label"].dataType.simpleString()
    return cut_lineage(numbered.select("label", "part", "rep", "hash", "vec", "bounds").groupBy("part").applyInPandas(store, f"label {kind}, part long, data binary")), total


def meetings(buckets: DataFrame, parts: DataFrame, number: int, same_label: bool) -> tuple[DataFrame, int]:
    """Streams of (part, run): the part first, then the buckets of the run that it has to meet, longest first."""
    spark = buckets.sparkSession
    count = buckets.count()
    runs = max(-(-count // RUN_BUCKETS), min(count, -(-2 * spark.sparkContext.defaultParallelism // max(number, 1))), 1)
    dealt = buckets.withColumn("run", F.pmod(F.xxhash64("bucket"), F.lit(runs)))
    ranges = parts.groupBy("label").agg(F.min("part").alias("__low"), F.max("part").alias("__high"))
    if same_label:
        met = spread_join(dealt, ranges, ["label"]).withColumn("part", F.explode(F.sequence("__low", "__high")))
    else:
        every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(number - 1).cast("long")))
        met = spread_join(dealt, ranges, ["label"], "left").withColumn("part", every).where("__low IS NULL OR part NOT BETWEEN __low AND __high")
    columns = ["part", "run", "kind", "norm", "bucket", "data"]
    met = met.withColumn("kind", F.lit(1)).select(*columns)
    runs_of_part = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(runs - 1).cast("long")))
    asked = parts.select("part", runs_of_part.alias("run"), F.lit(0).alias("kind"), F.lit(None).cast("double").alias("norm"), F.lit("").alias("bucket"), "data")
    tasks = max(1, min(number * runs, 20_000))
    both = asked.unionByName(met).repartition(tasks, "part", "run")
    return both.sortWithinPartitions("part", "run", "kind", F.col("norm").desc(), "bucket").select("kind", "data"), tasks


def found(streams: DataFrame, k: int, low: int, high: int) -> DataFrame:
    """rep, hash, bound, vec_id, score and own: for each anchor, or each of its bounds, the ``k`` best of a run.

    With bounds, only rows whose score is ``low`` to ``high`` percent of the bound count.
    """

    def results(part: dict, wanted: list[list[Best]]) -> pd.DataFrame:
        at, rows = 0, {name: [] for name in ("rep", "hash", "bound", "vec_id", "score", "own")}
        for rep, code, n, bests in zip(part["rep"], part["hash"], part["held"], wanted, strict=True):
            for bound, best in zip(part["bounds"][at : at + n] if n else [0], bests, strict=True):
                size = len(best.ids)
                for name, value in zip(rows, (np.full(size, rep, np.int64), np.full(size, code, np.int64), np.full(size, bound, np.int64), best.ids, best.scores, best.own), strict=True):
                    rows[name].append(value)
            at += int(n)
        return pd.DataFrame({name: np.concatenate(values) for name, values in rows.items()})

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, wanted = None, []
        for frame in frames:
            for kind, data in zip(frame["kind"], frame["data"], strict=True):
                # Narrow as stored; whole sums need room.
                arrays = {name: values.astype(np.int64) for name, values in np.load(io.BytesIO(data)).items()}
                if kind == 0:
                    if part is not None:
                        yield results(part, wanted)
                    part, wanted, at = arrays, [], 0
                    for n in part["held"]:
                        bounds = part["bounds"][at : at + n]
                        # low * bound <= 100 * score <= high * bound, in whole numbers.
                        wanted.append([Best.empty(k, -((-low * int(b)) // 100), (high * int(b)) // 100) for b in bounds] if n else [Best.empty(k)])
                        at += int(n)
                else:
                    bucket = Bucket(arrays["vectors"], arrays["ids"])
                    for anchor, bests in zip(part["vectors"], wanted, strict=True):
                        search(bucket, anchor, bests)
        if part is not None:
            yield results(part, wanted)

    return streams.mapInPandas(run, "rep long, hash long, bound long, vec_id long, score long, own boolean")


def hard_negatives(
    rows: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100
) -> DataFrame:
    """Negatives that score ``low`` to ``high`` percent of a positive's score, for each anchor and positive.

    ``rows`` has vec_id (long), label and vec (whole numbers), equal rows once. A score is the inner
    product; components that only the longer of two vectors has count as 0. An anchor's positives
    are the ``positives`` best other rows of its label, its negatives for one of them the
    ``negatives`` best rows of other labels in the window; higher scores first, ties to the smaller
    vec_id, all if there are fewer. Equal vectors of one label are searched once: of their rows only
    the smallest ids can be needed. An anchor is its own row only: another vector under its vec_id
    is another row. Returns anchor_id, positive_id, rank (among the negatives), negative_id,
    positive_score and negative_score; an empty table gives an empty result.
    """
    rows = cut_lineage(rows)
    keep = max(positives + 1, negatives)
    code = F.xxhash64("label", "vec").alias("hash")
    distinct = top_rows(rows, ["label", "vec"], [F.col("vec_id")], keep).groupBy("label", "vec").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    chosen = rows.where(is_anchor)
    asked = cut_lineage(chosen.groupBy("label", "vec").agg(F.min("vec_id").alias("rep")).select("label", "rep", code, "vec"))
    kinds = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if asked.isEmpty():
        return rows.sparkSession.createDataFrame([], kinds)
    buckets = length_buckets(distinct)
    parts, number = anchor_parts(asked.withColumn("bounds", F.lit(None).cast("array<bigint>")))
    best = [F.col("score").desc(), F.col("vec_id")]
    streams, _ = meetings(buckets, parts, number, same_label=True)
    near = cut_lineage(top_rows(found(streams, positives + 1, low, high), ["rep", "hash"], best, positives + 1))
    bounds = near.groupBy("rep", "hash").agg(F.array_sort(F.collect_set("score")).alias("bounds"))
    second = spread_join(asked, bounds, ["rep", "hash"])
    parts, number = anchor_parts(cut_lineage(second))
    streams, _ = meetings(buckets, parts, number, same_label=False)
    far = top_rows(found(streams, negatives, low, high), ["rep", "hash", "bound"], best, negatives, "rank")
    # At most ``positives`` + 1 bounds of ``negatives`` rows for one anchor vector.
    far = far.groupBy("rep", "hash", "bound").agg(F.sort_array(F.collect_list(F.struct("rank", "vec_id", "score"))).alias("rows"))
    pairs = near.drop("bound").withColumnRenamed("score", "bound").join(far, ["rep", "hash", "bound"], "left").groupBy("rep", "hash").agg(
        F.collect_list(F.struct(F.col("vec_id").alias("id"), F.col("bound").alias("score"), "own", "rows")).alias("positives")
    )
    anchors = chosen.select(F.col("vec_id").alias("anchor_id"), code, "label", "vec")
    named = spread_join(anchors, asked.select("label", "vec", "rep"), ["label", "vec"]).select("anchor_id", "rep", "hash")
    held = spread_join(named, pairs, ["rep", "hash"])
    others = F.filter("positives", lambda p: ~(p["own"] & (p["id"] == F.col("anchor_id"))))
    ordered = F.slice(F.array_sort(others, lambda a, b: F.when(a["score"] > b["score"], -1).when(a["score"] < b["score"], 1).when(a["id"] < b["id"], -1).when(a["id"] > b["id"], 1).otherwise(0)), 1, positives)
    each = held.select("anchor_id", F.explode(ordered).alias("p")).select("anchor_id", "p", F.explode("p.rows").alias("n"))
    return each.select(
        "anchor_id", F.col("p.id").alias("positive_id"), F.col("n.rank").cast("int").alias("rank"), F.col("n.vec_id").alias("negative_id"),
        F.col("p.score").alias("positive_score"), F.col("n.score").alias("negative_score"),
    )


def mine_embeddings(embeddings: DataFrame) -> DataFrame:
    """``hard_negatives`` of ``embeddings`` (vec_id, embedding, label): rows with vec_id divisible by 7 take the next label of ten, those divisible by 100 are anchors."""
    label = F.expr("CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END")
    return hard_negatives(finite_vectors(embeddings, label), F.col("vec_id") % 100 == 0)
