"""Language identification as inference of a mixture of languages.

Byte n-gram counts of the labelled documents give one smoothed n-gram distribution per language.
For each document, expectation-maximisation estimates the proportions in which the languages
explain its n-grams; the set of languages is chosen by penalised likelihood. Training is one pass
whose partial counts are combined by key; the model is languages x buckets numbers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import chunks, joined_bytes, lower_ascii, utf8

BITS = 14
ROUNDS = 12
# Each character lies in four overlapping n-grams, so their likelihoods count four times over.
OVERLAP = 4.0


def ngram_buckets(values: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed byte 4-grams of all values, lower-cased in ASCII, and the index of the value each lies in.

    A value is set between two spaces on either side, so also a single letter has n-grams.
    """
    data, firsts, ends = joined_bytes(values, b"  ")
    data = lower_ascii(data).astype(np.uint32)
    codes = data[:-3] | (data[1:-2] << np.uint32(8)) | (data[2:-1] << np.uint32(16)) | (data[3:] << np.uint32(24))
    buckets = (codes * np.uint32(2654435761)) >> np.uint32(32 - BITS)
    owner = np.repeat(np.arange(len(values)), ends - firsts + 2)[: len(buckets)]
    return buckets, np.pad(owner, (0, len(buckets) - len(owner)), constant_values=max(len(values) - 1, 0))


def count_ngrams(labelled: DataFrame) -> DataFrame:
    """``labelled`` (lang, data binary): n-gram counts (lang, bucket, n), summed within each task first."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}
        for batch in chunks(batches, "data"):
            langs = np.array(batch.column("lang").to_pylist(), dtype=object)
            for lang in set(langs):
                rows = pa.array(np.flatnonzero(langs == lang))
                buckets, _ = ngram_buckets(batch.column("data").take(rows).to_pylist())
                held = totals.setdefault(lang, np.zeros(1 << BITS, dtype=np.int64))
                held += np.bincount(buckets, minlength=1 << BITS)
        for lang, held in totals.items():
            at = np.flatnonzero(held)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at)), pa.array(at.astype(np.int32)), pa.array(held[at])], names=["lang", "bucket", "n"])

    return labelled.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


def fit(counts: DataFrame, rows: DataFrame) -> tuple[list[str], np.ndarray, int]:
    """Languages in order, log-likelihoods (languages x buckets), and the most frequent language's place.

    The driver gets at most languages x 2 ** BITS counts. ``rows`` has ``lang`` of the labelled documents.
    """
    table = counts.toPandas()
    langs = sorted(table["lang"].unique())
    grid = np.full((len(langs), 1 << BITS), 0.5)
    for place, lang in enumerate(langs):
        mine = table[table["lang"] == lang]
        grid[place, mine["bucket"].to_numpy()] += mine["n"].to_numpy()
    sizes = dict(rows.groupBy("lang").count().collect())
    common = max(range(len(langs)), key=lambda place: (sizes.get(langs[place], 0), -place)) if langs else 0
    return langs, np.log(grid / grid.sum(axis=1, keepdims=True)), common


def mixtures(model: np.ndarray, grams: np.ndarray, owner: np.ndarray, weight: np.ndarray, docs: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Proportions (docs x languages), log-likelihood of the mixture and of each language alone.

    ``grams``, ``owner`` and ``weight`` are the distinct n-grams of each document, in document order;
    every document has one at least.
    """
    first = np.flatnonzero(np.diff(owner, prepend=-1))
    logs = model.T[grams]
    alone = np.add.reduceat(logs * weight[:, None], first, axis=0)
    top = logs.max(axis=1)
    likely = np.exp(logs - top[:, None])
    total = np.add.reduceat(weight, first)
    share = np.full((docs, model.shape[0]), 1.0 / model.shape[0])
    for _ in range(ROUNDS):
        parts = share[owner] * likely
        parts *= (weight / parts.sum(axis=1))[:, None]
        share = np.add.reduceat(parts, first, axis=0) / total[:, None]
    mixed = np.add.reduceat(weight * (np.log((share[owner] * likely).sum(axis=1)) + top), first)
    return share, mixed, alone


def select_languages(model: np.ndarray, grams: np.ndarray, weight: np.ndarray, share: np.ndarray) -> tuple[list[int], np.ndarray]:
    """The set of languages of one document by penalised likelihood, and their proportions."""
    order, penalty = np.argsort(-share, kind="stable"), OVERLAP * np.log(weight.sum() + 1)
    best = None
    for size in range(1, len(order) + 1):
        kept = order[:size]
        part, mixed, _ = mixtures(model[kept], grams, np.zeros(len(grams), dtype=np.int64), weight, 1)
        value = mixed[0] - penalty * size
        if best is not None and value <= best[0]:
            break
        best = (value, kept.tolist(), part[0])
    return best[1], best[2]


def identify(documents: DataFrame, training: DataFrame, keep: list[str]) -> DataFrame:
    """Language of every row of ``documents`` (``text`` and the columns ``keep``), learned from ``training`` (text, lang).

    Returns ``keep``, ``lang_pred``, ``score`` and ``languages``. ``lang_pred`` is the largest part of
    the selected languages, ``und`` with score 0 for a null text, one without a letter, or where
    nothing could be learned (no training row has a language and a text). ``score`` is that
    language's proportion, 0 to 1; ``languages`` maps each selected language to its proportion. Ties go to the language
    that comes first by name. Equal texts get equal results; no column but ``text`` is used.
    """
    labelled = training.where("lang IS NOT NULL AND text IS NOT NULL").select("lang", utf8().alias("data"))
    langs, model, _ = fit(count_ngrams(labelled), labelled)
    result = "lang_pred string, score double, languages map<string,double>"
    spelled = documents.select(*keep, F.when(F.col("text").rlike(r"\p{L}"), F.col("text").cast("binary")).alias("__data"))
    fields = ", ".join(f"`{name}` {kind}" for name, kind in spelled.dtypes[:-1])

    def infer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "__data"):
            predicted, scores, sets = [["und"] * batch.num_rows, [0.0] * batch.num_rows, [[] for _ in range(batch.num_rows)]]
            data = batch.column("__data")
            rows = np.flatnonzero(np.asarray(data.is_valid())) if langs else []
            if len(rows):
                buckets, owner = ngram_buckets(data.take(pa.array(rows)).to_pylist())
                keys = np.sort((owner.astype(np.int64) << BITS) | buckets)
                at = np.flatnonzero(np.diff(keys, prepend=-1))
                weight = np.diff(at, append=len(keys)).astype(float)
                owner, grams = keys[at] >> BITS, keys[at] & ((1 << BITS) - 1)
                share, mixed, alone = mixtures(model, grams, owner, weight, len(rows))
                starts = np.append(np.flatnonzero(np.diff(owner, prepend=-1)), len(owner))
                for nth, row in enumerate(rows):
                    part = slice(starts[nth], starts[nth + 1])
                    single = int(share[nth].argmax())
                    if mixed[nth] - alone[nth, single] <= OVERLAP * np.log(weight[part].sum() + 1):
                        chosen, parts = [single], np.ones(1)
                    else:
                        chosen, parts = select_languages(model, grams[part], weight[part], share[nth])
                    top = int(parts.argmax())
                    predicted[row] = langs[chosen[top]]
                    scores[row] = float(share[nth, single]) if len(chosen) == 1 else float(parts[top])
                    sets[row] = [(langs[place], float(value)) for place, value in zip(chosen, parts, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(predicted), pa.array(scores), pa.array(sets, pa.map_(pa.string(), pa.float64()))],
                names=[*batch.schema.names[:-1], "lang_pred", "score", "languages"],
            )

    return spelled.mapInArrow(infer, f"{fields}, {result}")


def held_out(parts: int, part: int):
    """Whether crc32 of the doc_id as text falls in ``part`` of ``parts``; a null id never does."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(parts)) == part, F.lit(False))


def predict_languages(documents: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, languages of all ``documents``, learned from those that are not held out."""
    return identify(documents.select("doc_id", "text", held_out(5, 0).alias("held_out")), documents.where(~held_out(5, 0)), ["doc_id", "held_out"])
