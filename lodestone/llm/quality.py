"""Quality scores from supervised subword embeddings.

A document is the average of learned vectors of its words and of its byte 4-grams, hashed into one
table, under a softmax over the labels; the table and the output weights are trained by stochastic
gradient descent in numpy on a bounded sample of labelled rows. Scoring is linear in the embeddings,
so each bucket's two logits are folded into one number that is sent to the tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import chunks, joined_bytes, lower_ascii, utf8
from lodestone.llm.language import held_out

BITS = 16
WIDTH = 8
LABELLED_ROWS = 10_000
EPOCHS = 10
RATE = 0.5


def features(values: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all words and byte 4-grams of the values, and the index of the value each belongs to.

    Words are runs of bytes above the space, in ASCII lower case. A value with no byte has four
    4-grams of spaces, so that it has a vector like any other.
    """
    data, firsts, ends = joined_bytes(values, b"   ")
    data = lower_ascii(data)
    wide = data.astype(np.uint32)
    codes = wide[:-3] | (wide[1:-2] << np.uint32(8)) | (wide[2:-1] << np.uint32(16)) | (wide[3:] << np.uint32(24))
    grams = (codes * np.uint32(2654435761)) >> np.uint32(32 - BITS)
    owner = np.repeat(np.arange(len(values)), ends - firsts + 3)[: len(grams)]
    inside = data > 32
    edge = np.diff(inside.astype(np.int8), prepend=0, append=0)
    starts, stops = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    # A polynomial of the word's bytes: the sum of byte x power, taken back to the word's start.
    with np.errstate(over="ignore"):
        base, back = np.uint64(0x9E3779B97F4A7C15), np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
        power = np.cumprod(np.full(len(data), base))
        undo = np.cumprod(np.full(len(data), back))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power)])
        hashed = (sums[stops] - sums[starts]) * undo[starts] if len(starts) else np.zeros(0, np.uint64)
        hashed = (hashed ^ (hashed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    words = (hashed >> np.uint64(64 - BITS)).astype(np.uint32) | np.uint32(1 << BITS)
    return np.concatenate([grams, words]), np.concatenate([owner, np.searchsorted(ends, starts, side="right")])


def train(rows: list[tuple[np.ndarray, np.ndarray, int]], seed: int = 7) -> tuple[np.ndarray, float]:
    """One number per bucket and a bias, whose average and sum give the log-odds of label 1.

    ``rows`` has distinct buckets, their counts, and the label of each document.
    """
    random = np.random.default_rng(seed)
    table = random.uniform(-1 / WIDTH, 1 / WIDTH, (2 << BITS, WIDTH)).astype(np.float32)
    output, bias = np.zeros((2, WIDTH), np.float32), np.zeros(2, np.float32)
    steps, done = EPOCHS * len(rows), 0
    for _ in range(EPOCHS):
        for place in random.permutation(len(rows)):
            buckets, counts, label = rows[place]
            weight = (counts / counts.sum()).astype(np.float32)
            hidden = weight @ table[buckets]
            logits = output @ hidden + bias
            odds = np.exp(logits - logits.max())
            error = odds / odds.sum()
            error[label] -= 1
            rate = np.float32(RATE * (1 - done / steps))
            back = error @ output
            output -= rate * np.outer(error, hidden)
            bias -= rate * error
            # The step of a row of the table is scaled by the row's share; the common scale makes up for long documents.
            table[buckets] -= np.outer(weight * (rate * len(buckets) ** 0.5), back)
            done += 1
    return table @ (output[1] - output[0]), float(bias[1] - bias[0])


def labelled_sample(labels: DataFrame, rows: int) -> DataFrame:
    """At most ``rows`` distinct labelled ids, taken by hash; rows without an id or a label of 0 or 1 are left out."""
    known = labels.where("doc_id IS NOT NULL AND quality IN (0, 1)").select("doc_id", "quality").distinct()
    return known.orderBy(F.xxhash64("doc_id", "quality"), "doc_id", "quality").limit(rows)


def fit(documents: DataFrame, labels: DataFrame, rows: int = LABELLED_ROWS) -> tuple[np.ndarray, float]:
    """Train in one task on the bounded sample (its whole texts); the driver gets the folded model only.

    Without a document of either label all scores are 0.5.
    """
    # The sample has at most ``rows`` rows of two numbers: proven small.
    texts = documents.select("doc_id", utf8().alias("data")).join(F.broadcast(labelled_sample(labels, rows)), "doc_id")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "data"):
            buckets, owner = features(batch.column("data").to_pylist())
            keys, counts = np.unique((owner.astype(np.int64) << (BITS + 1)) | buckets, return_counts=True)
            cuts = np.searchsorted(keys, np.arange(1, batch.num_rows) << (BITS + 1))
            kept = (keys & ((2 << BITS) - 1)).astype("<u4")
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").cast(pa.string()), batch.column("quality").cast(pa.int32()),
                    pa.array([part.tobytes() for part in np.split(kept, cuts)], pa.binary()),
                    pa.array([part.astype("<u4").tobytes() for part in np.split(counts, cuts)], pa.binary()),
                ],
                names=["doc", "quality", "buckets", "counts"],
            )

    def learn(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = [
            (row.doc, row.buckets, row.counts, int(row.quality)) for frame in frames for row in frame.itertuples(index=False)
        ]
        # In one order whatever task sent them first.
        rows = [(np.frombuffer(buckets, "<u4").astype(np.int64), np.frombuffer(counts, "<u4"), label) for _, buckets, counts, label in sorted(held)]
        if len({label for *_, label in rows}) == 2:
            folded, bias = train(rows)
            yield pd.DataFrame({"folded": [folded.astype("<f4").tobytes()], "bias": [bias]})

    counted = texts.mapInArrow(count, "doc string, quality int, buckets binary, counts binary")
    model = counted.repartition(1).mapInPandas(learn, "folded binary, bias double").first()
    if model is None:
        return np.zeros(2 << BITS, np.float32), 0.0
    return np.frombuffer(bytes(model[0]), "<f4"), model[1]


def score(documents: DataFrame, model: tuple[np.ndarray, float], keep: list[str]) -> DataFrame:
    """``keep`` and ``score``, the chance of label 1, for every row; a null text counts as empty. Equal texts score alike."""
    folded, bias = model
    rows = documents.select(*keep, utf8().alias("__data"))
    fields = ", ".join(f"`{name}` {kind}" for name, kind in rows.dtypes[:-1])

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "__data"):
            buckets, owner = features(batch.column("__data").to_pylist())
            total = np.bincount(owner, weights=folded[buckets], minlength=batch.num_rows)
            odds = total / np.bincount(owner, minlength=batch.num_rows) + bias
            # Rounded so that the order in which a text's parts are added up leaves no trace.
            chance = np.round(1 / (1 + np.exp(-np.clip(odds, -60, 60))), 9)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(chance)], names=[*batch.schema.names[:-1], "score"])

    return rows.mapInArrow(rate, f"{fields}, score double")


def predict_quality(documents: DataFrame, labels: DataFrame, rows: int = LABELLED_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted of all ``documents``, learned from labelled rows that are not held out."""
    held = held_out(3, 1)
    model = fit(documents, labels.where(~held), rows)
    scored = score(documents.select("doc_id", "text", held.alias("held_out")), model, ["doc_id", "held_out"])
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
