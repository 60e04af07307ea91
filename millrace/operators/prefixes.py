"""Digests of everything up to a row, carried along as a running hash state, and prompts held to them."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def running_digests(log: DataFrame, session: str, order: Sequence[str], line: Column) -> DataFrame:
    """``session, order..., before, upto``: SHA-256 of the lines of a session before a row, and up to it, joined by LF.

    Work is linear in the text: a hash state is carried from row to row and copied, so no prefix is ever built. A digest of all
    that came before is sequential by its definition, so a session streams through one task; nothing of it is held but the state.
    ``before`` is null at a session's first row. A null line is empty.
    """
    rows = log.select(session, *order, F.coalesce(line, F.lit("")).alias("_line"))
    dealt = rows.repartition(session).sortWithinPartitions(session, *order, "_line")
    kept = rows.drop("_line").schema
    names = [*kept.names, "before", "upto"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current: object = run
        state, before = hashlib.sha256(), None
        for batch in batches:
            for start in range(0, batch.num_rows, 1024):
                part = batch.slice(start, 1024)
                told: list[tuple] = []
                for key, text in zip(part.column(0).to_pylist(), part.column(part.num_columns - 1).to_pylist(), strict=True):
                    if key != current:
                        current, state, before = key, hashlib.sha256(), None
                    state.update(("" if before is None else "\n").encode() + text.encode())
                    upto = state.hexdigest()  # of a copy: the state goes on
                    told.append((before, upto))
                    before = upto
                columns = [pa.array(c, pa.string()) for c in zip(*told, strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *columns], names=names)

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), "before string", "upto string"])
    return dealt.mapInArrow(run, schema)


def prompt_leaks(claims: DataFrame, digests: DataFrame, session: str, order: str) -> DataFrame:
    """Of ``claims(session, order, claimed)`` those that are not the digest before their row: with ``leak`` and ``at``.

    ``future`` and ``past`` say that the prompt is what a later or an earlier row has before it, and ``at`` which; ``unknown`` that it is no prefix
    of the session at all; ``no_row`` that there is no such row. A digest stands for one prefix, so each claim meets one row at most.
    """
    own = digests.select(F.col(session).alias("_s"), F.col(order).alias("_o"), F.col("before").alias("_own"), F.lit(True).alias("_row"))
    met = claims.join(own, claims[session].eqNullSafe(own["_s"]) & (claims[order] == own["_o"]), "left")
    wrong = met.where(F.col("_row").isNull() | ~F.col("claimed").eqNullSafe(F.col("_own"))).select(session, order, "claimed", "_row")
    prefixes = digests.select(F.col(session).alias("_s"), F.col("upto").alias("_upto"), F.col(order).alias("at"))
    # A prompt that ends at row ``at`` is the one of the row after it.
    found = wrong.join(prefixes, wrong[session].eqNullSafe(prefixes["_s"]) & (wrong["claimed"] == prefixes["_upto"]), "left")
    leak = F.when(F.col("_row").isNull(), "no_row").when(F.col("at").isNull(), "unknown").when(F.col("at") >= F.col(order), "future").otherwise("past")
    return found.select(session, order, leak.alias("leak"), "at")
