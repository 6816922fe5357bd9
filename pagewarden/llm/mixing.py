"""Pfair mixing of sources: blocks of documents interleaved so that every prefix has each source's share, to less than a block.

A source of weight w gets one block in each window of its own: block j may not start before slot floor(j / w) and must
be out by slot ceil((j + 1) / w). Serving the earliest deadline among released blocks meets all of them. Weights are
whole shares of a cycle, so the schedule repeats; only one cycle is worked out, on the driver. When a source runs out,
its share goes to the others in proportion and a new phase begins, so no document is dropped or repeated.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import near_equal_buckets, ranked

BLOCK_ROWS, CYCLE = 16, 1000
#: Rows of a source that are ranked together about; they are whole texts in the pipeline, so few fit in a task.
_RANKED_ROWS = 2_000


def shares(weights: dict[str, float], cycle: int) -> dict[str, int]:
    """Whole shares of the cycle, at least one each, by largest remainder."""
    total = sum(weights.values())
    exact = {s: w / total * (cycle - len(weights)) for s, w in weights.items()}
    out = {s: 1 + int(x) for s, x in exact.items()}
    for s in sorted(weights, key=lambda s: (int(exact[s]) - exact[s], s))[: cycle - sum(out.values())]:
        out[s] += 1
    return out


def one_cycle(share: dict[str, int]) -> dict[str, list[int]]:
    """The slots of each source in a cycle of sum(share) slots: earliest deadline first among released blocks."""
    cycle = sum(share.values())
    waiting = [(0, s, 0) for s in sorted(share)]  # (release, source, block)
    heapq.heapify(waiting)
    ready: list[tuple[int, int, str, int]] = []
    slots: dict[str, list[int]] = {s: [] for s in share}
    for t in range(cycle):
        while waiting and waiting[0][0] <= t:
            _, s, j = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(j + 1) * cycle // share[s]), share[s], s, j))
        _, _, s, j = heapq.heappop(ready)
        slots[s].append(t)
        if j + 1 < share[s]:
            heapq.heappush(waiting, ((j + 1) * cycle // share[s], s, j + 1))
    return slots


def schedule(n_rows: dict[str, int], weights: dict[str, float], block_rows: int = BLOCK_ROWS, cycle: int = CYCLE) -> tuple[list[tuple], list[tuple]]:
    """Phases as rows (phase, source, first_block, end_block, first_slot, share, cycle, missing) and their cycles as rows (phase, source, nth, slot).

    ``missing`` counts the rows that short last blocks of earlier phases lack.
    """
    left = {s: -(-n // block_rows) for s, n in n_rows.items() if n}
    done = dict.fromkeys(left, 0)
    phases, cycles, base, missing, number = [], [], 0, 0, 0
    while left:
        share = shares({s: max(weights.get(s, 0.0), 1e-12) for s in left}, max(cycle, 2 * len(left)))
        slots, length = one_cycle(share), sum(share.values())
        at = lambda s, j: j // share[s] * length + slots[s][j % share[s]]  # noqa: B023, E731
        end, over = min((at(s, n - 1) + 1, s) for s, n in left.items())
        for s in sorted(left):
            whole, rest = divmod(end, length)
            got = whole * share[s] + sum(x < rest for x in slots[s])
            if got:
                phases.append((number, s, done[s], done[s] + got, base, share[s], length, missing))
            done[s], left[s] = done[s] + got, left[s] - got
        cycles += [(number, s, k, x) for s in sorted(share) for k, x in enumerate(slots[s])]
        missing += -n_rows[over] % block_rows
        base, number = base + end, number + 1
        del left[over]
    return phases, cycles


NEW = ("phase", "block", "slot", "position", "share")


def mix(docs: DataFrame, weights: dict[str | None, float] | None = None, block_rows: int = BLOCK_ROWS, cycle: int = CYCLE) -> DataFrame:
    """Adds phase, block, slot, position and share to rows with doc_id and source; every other column is kept.

    Columns of ``docs`` with these names are replaced; no other name is taken. ``weights`` are relative, by source; a
    source not named in them weighs next to nothing, and without weights each source weighs the square root of its
    rows. ``position`` is the row's place in the mixture, gapless from 0. Within a source, rows stand in hash order. A
    null source is a source of its own; a null doc_id is one like others; repeated rows each get a place; an empty
    table gives an empty result. The driver holds a few numbers for each source and phase, so sources should be
    thousands at most.
    """
    spark = docs.sparkSession
    key = F.when(F.col("source").isNull(), "n").otherwise(F.concat(F.lit("s"), F.col("source")))
    named = lambda s: "n" if s is None else f"s{s}"
    columns = [c for c in docs.columns if c not in NEW]
    whole = [F.col(f"`{c}`") for c in columns if "map<" not in docs.schema[c].dataType.simpleString() and "variant" not in docs.schema[c].dataType.simpleString()]
    # the rows' own columns stay inside one, so that none of them can clash with those made here
    rows = docs.select(key.alias("_source"), F.xxhash64("doc_id").alias("_order"), F.xxhash64(*whole).alias("_tie"), F.struct(*[F.col(f"`{c}`") for c in columns]).alias("_row"))
    n_rows = {r[0]: int(r[1]) for r in rows.groupBy("_source").count().collect()}
    by_key = {s: n**0.5 for s, n in n_rows.items()} if weights is None else {named(s): float(w) for s, w in weights.items()}
    phases, cycles = schedule(n_rows, by_key, block_rows, cycle)
    phase = spark.createDataFrame(phases, "phase int, _source string, first_block long, end_block long, first_slot long, share int, cycle int, missing long")
    turn = spark.createDataFrame(cycles, "phase int, _source string, _nth int, _slot int")
    placed = ranked(rows, ["_source"], "_order", ["_tie"], near_equal_buckets(sum(n_rows.values()), _RANKED_ROWS), "_rank")
    placed = placed.withColumn("block", F.floor(F.col("_rank") / block_rows).cast("long"))
    spans = phase.groupBy("_source").agg(F.array_sort(F.collect_list(F.struct("first_block", "end_block", "phase", "first_slot", "share", "cycle", "missing"))).alias("_spans"))  # phases of a source, at most as many as there are sources
    placed = placed.join(F.broadcast(spans), "_source") if len(phases) <= 20_000 else placed.join(spans, "_source")
    span = F.element_at(F.filter("_spans", lambda x: (x["first_block"] <= F.col("block")) & (F.col("block") < x["end_block"])), 1)
    placed = placed.withColumn("_span", span).drop("_spans").withColumn("_j", F.col("block") - F.col("_span.first_block"))
    placed = placed.withColumn("phase", F.col("_span.phase")).withColumn("_nth", F.pmod("_j", F.col("_span.share")).cast("int"))
    placed = placed.join(F.broadcast(turn) if len(cycles) <= 100_000 else turn, ["phase", "_source", "_nth"])
    slot = F.col("_span.first_slot") + F.floor(F.col("_j") / F.col("_span.share")) * F.col("_span.cycle") + F.col("_slot")
    placed = placed.withColumn("slot", slot.cast("long")).withColumn("share", F.col("_span.share") / F.col("_span.cycle"))
    placed = placed.withColumn("position", (F.col("slot") * block_rows + F.pmod("_rank", F.lit(block_rows)) - F.col("_span.missing")).cast("long"))
    return placed.select(*[F.col("_row").getField(c).alias(c) for c in columns], *NEW)


def op6_mixing(docs: DataFrame) -> DataFrame:
    """Places of all documents in a mixture whose sources weigh the square roots of their sizes."""
    return mix(docs.select("doc_id", "source"))
