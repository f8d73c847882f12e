"""Order-dependent state machines over keys of any size.

Greedy grouping, admission and dialogue state depend on everything that came before in the same
key. Rows are therefore cut into balanced, ordered chunks (a hot key spans many), every chunk is
run from an assumed incoming state, and chunks whose assumption turned out wrong are run again
until the states agree. The first chunk of a key is always right, so the fixpoint is the exact
sequential result; with bounded memory (a time window) a second round usually settles it.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from itertools import groupby
from operator import itemgetter
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from lodestone.session import cut_lineage

# One key's rows in order (a frame, or a list of named tuples) and its state before them -> one result per row and the state after.
Step = Callable[[Any, Any], tuple[list[dict[str, Any]], Any]]
STATE_SCHEMA = "chunk int, first_key string, last_key string, incoming string, outgoing string"


def _runs(rows: pd.DataFrame, key: str, tuples: bool) -> Iterator[tuple[Any, Any]]:
    if tuples:
        # Converted once a chunk: a frame a key costs milliseconds, whatever it holds.
        plain = rows.astype(object).where(rows.notna(), None)
        for value, run in groupby(plain.itertuples(index=False), itemgetter(rows.columns.get_loc(key))):
            yield value, list(run)
        return
    changes = (rows[key] != rows[key].shift()).cumsum()
    for _, run in rows.groupby(changes, sort=False):
        yield run[key].iloc[0], run


def _play(
    rows: pd.DataFrame, key: str, order: list[str], step: Step, incoming: str | None, tuples: bool = False
) -> tuple[list[dict[str, Any]], str, str, Any]:
    rows = rows.sort_values([key, *order], kind="stable").reset_index(drop=True)
    results: list[dict[str, Any]] = []
    state = json.loads(incoming) if incoming else None
    first = last = None
    for value, run in _runs(rows, key, tuples):
        if first is None:
            first = value
        elif value != last:
            state = None
        found, state = step(run, state)
        results += found
        last = value
    return results, str(first), str(last), state


def ordered_scan(
    df: DataFrame, key: str, order: list[str], step: Step, result: StructType, rows_per_chunk: int = 100_000, reads: list[str] | None = None,
    tuples: bool = False,
) -> DataFrame:
    """Run ``step`` along every key in order; returns the rows with the ``result`` columns added.

    ``reads`` names the columns that ``step`` looks at beside the key and the order (all, if None).
    Only these go through Python; the results are joined back by the row's place in the checkpoint.
    With ``tuples`` a step gets named tuples (None for missing values), which many small keys need; else a frame.
    """
    session = df.sparkSession
    # Computed once; counting and range sampling read the checkpoint.
    held = cut_lineage(df)
    chunks = max(1, -(-held.count() // rows_per_chunk))
    placed = cut_lineage(
        held.repartitionByRange(chunks, key, *order).withColumns({"chunk": F.spark_partition_id(), "__place": F.monotonically_increasing_id()})
    )
    seen = df.columns if reads is None else list(dict.fromkeys([key, *order, *reads]))
    narrow = placed.select("chunk", "__place", *seen)

    def run_states(frame: pd.DataFrame, assumed: pd.DataFrame) -> pd.DataFrame:
        if frame.empty:
            return pd.DataFrame(columns=["chunk", "first_key", "last_key", "incoming", "outgoing"])
        incoming = assumed["incoming"].iloc[0] if len(assumed) else None
        _, first, last, state = _play(frame, key, order, step, incoming, tuples)
        outgoing = None if state is None else json.dumps(state)
        return pd.DataFrame([[int(frame["chunk"].iloc[0]), first, last, incoming, outgoing]],
                            columns=["chunk", "first_key", "last_key", "incoming", "outgoing"])

    nothing = session.createDataFrame([], "chunk int, incoming string")
    states = cut_lineage(narrow.groupBy("chunk").cogroup(nothing.groupBy("chunk")).applyInPandas(run_states, STATE_SCHEMA))
    for _ in range(chunks):
        handed = states.select((F.col("chunk") + 1).alias("chunk"), F.col("last_key").alias("first_key"), F.col("outgoing").alias("handed"))
        linked = states.join(handed, ["chunk", "first_key"], "left")
        wrong = linked.where(~F.col("handed").eqNullSafe(F.col("incoming")))
        todo = cut_lineage(wrong.select("chunk", F.col("handed").alias("incoming")))
        if todo.isEmpty():
            break
        again = narrow.join(todo.select("chunk"), "chunk", "left_semi").groupBy("chunk").cogroup(todo.groupBy("chunk")).applyInPandas(
            run_states, STATE_SCHEMA
        )
        states = cut_lineage(states.join(todo.select("chunk"), "chunk", "left_anti").unionByName(again))

    names = [field.name for field in result.fields]
    schema = StructType([StructField("__place", LongType()), *result.fields])

    def run_rows(frame: pd.DataFrame, assumed: pd.DataFrame) -> pd.DataFrame:
        if frame.empty:
            return pd.DataFrame(columns=["__place", *names])
        incoming = assumed["incoming"].iloc[0] if len(assumed) else None
        frame = frame.sort_values([key, *order], kind="stable").reset_index(drop=True)
        found, _, _, _ = _play(frame, key, order, step, incoming, tuples)
        columns = {name: pd.Series([row[name] for row in found], dtype=object) for name in names}
        return pd.DataFrame({"__place": frame["__place"], **columns})

    found = narrow.groupBy("chunk").cogroup(states.select("chunk", "incoming").groupBy("chunk")).applyInPandas(run_rows, schema)
    return placed.join(found, "__place").select(*df.columns, *names)


def text_result(*names: str) -> StructType:
    return StructType([StructField(name, StringType()) for name in names])
