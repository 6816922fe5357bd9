"""Learned decision lists over text statistics.

Statistics of a text are array expressions over its own words and lines: nothing is shuffled. A bounded sample of
labelled documents is counted into cells of binned statistics; on these counts the driver grows conjunctions of
thresholds by information gain on two thirds of the sample, prunes them on the rest, removes what they cover and goes
on. The list found becomes one ordered CASE expression.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, first_by_hash, words_of

WINDOW, LEAST_WORDS = 5, 10
#: Statistics that rules may test, as ratios so that they mean the same at any length.
FEATURES = ("word_length", "symbol_ratio", "bang_ratio", "repeat_line_ratio", "repeat_word_ratio", "n_words")


def statistics(docs: DataFrame) -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed and the ratios in FEATURES to (doc_id, text).

    A null text is an empty one: no words, base_failed. Other columns are left out. Equal five-word windows are told
    by a 64-bit hash of their words.
    """
    text = F.coalesce("text", F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.btrim(x, F.lit(SPACE)) != "")
    out = docs.select(
        "doc_id",
        words_of(F.col("text")).alias("_words"),
        lines.alias("_lines"),
        F.length(F.regexp_replace(text, "[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        (F.length(text) - F.length(F.replace(text, F.lit("!")))).cast("long").alias("_bangs"),
    )
    out = out.select(
        "doc_id", "n_symbols", "_bangs", F.size("_words").cast("long").alias("n_words"), F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"), F.size("_lines").alias("_n_lines"), F.transform("_words", lambda w: F.xxhash64(w)).alias("_hashes"),
    )
    windows = F.transform(F.sequence(F.lit(0), F.col("_n") - WINDOW), lambda i: F.xxhash64(*[F.get("_hashes", i + k) for k in range(WINDOW)]))
    out = out.withColumn("_n", F.size("_hashes"))
    out = out.withColumn("_windows", F.when(F.col("_n") >= WINDOW, windows).otherwise(F.array().cast("array<bigint>")))
    repeats = F.size(F.array_distinct("_windows")) < F.size("_windows")
    out = out.withColumn("_sorted", F.when(repeats, F.sort_array(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    here = lambda i: F.get("_sorted", i)["h"]
    twice = F.filter("_sorted", lambda x, i: F.coalesce(x["h"] == here(i - 1), F.lit(False)) | F.coalesce(x["h"] == here(i + 1), F.lit(False)))
    out = out.withColumn("_at", F.sort_array(F.transform(twice, lambda x: x["i"])))
    covered = F.aggregate("_at", F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last")), lambda a, i: F.struct((a["n"] + F.least(F.lit(WINDOW), i - a["last"])).alias("n"), i.alias("last")))["n"]
    out = out.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long"))
    words = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    return out.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        ((F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))).alias("base_failed"),
        (F.col("word_chars") / words).alias("word_length"), (F.col("n_symbols") / words).alias("symbol_ratio"), (F.col("_bangs") / words).alias("bang_ratio"),
        (F.col("n_dup_lines") / F.greatest(F.col("_n_lines"), F.lit(1))).alias("repeat_line_ratio"), (F.col("n_repeat_words") / words).alias("repeat_word_ratio"),
    )


@dataclass(frozen=True)
class Rule:
    """A conjunction of (feature, above, threshold): feature > threshold if above, else feature <= threshold; its texts are rejected."""

    tests: tuple[tuple[str, bool, float], ...]
    precision: float

    def condition(self) -> Column:
        out = F.lit(True)
        for feature, above, threshold in self.tests:
            out &= (F.col(feature) > threshold) if above else (F.col(feature) <= threshold)
        return out


def _cells(sample: DataFrame, bins: int) -> tuple[list[tuple], dict[str, list[float]]]:
    """Counts (bin of each feature..., fold, low, rows) of labelled statistics, and the thresholds between bins."""
    cuts = sample.agg(*[F.percentile_approx(f, [(i + 1) / bins for i in range(bins - 1)], 10_000).alias(f) for f in FEATURES]).first()
    edges = {f: sorted({float(x) for x in cuts[f] or []} | {0.0}) for f in FEATURES}
    level = lambda f: F.size(F.filter(F.array(*[F.lit(x) for x in edges[f]]), lambda x: x < F.col(f)))
    grouped = sample.groupBy(*[level(f).alias(f) for f in FEATURES], "fold", "low").agg(F.count(F.lit(1)))
    return [tuple(r) for r in grouped.collect()], edges  # no more rows than the sample has


def _grow(cells: list[tuple], edges: dict[str, list[float]], most: int) -> list[tuple[int, bool, int]]:
    """Tests (feature, above, level), each the one of most information gain for low quality among what the ones before keep."""
    tests: list[tuple[int, bool, int]] = []
    while len(tests) < most:
        low, high = sum(c[-1] for c in cells if c[-2]), sum(c[-1] for c in cells if not c[-2])
        if not low or not high:
            break
        prior, best = math.log2(low / (low + high)), (1e-9, None)
        for k, f in enumerate(FEATURES):
            p, n = [0] * (len(edges[f]) + 1), [0] * (len(edges[f]) + 1)
            for c in cells:
                (p if c[-2] else n)[c[k]] += c[-1]
            for i in range(1, len(edges[f]) + 1):
                for above, a, b in ((True, sum(p[i:]), sum(n[i:])), (False, sum(p[:i]), sum(n[:i]))):
                    if a and (gain := a * (math.log2(a / (a + b)) - prior)) > best[0]:
                        best = (gain, (k, above, i))
        if best[1] is None:
            break
        tests.append(best[1])
        cells = _kept(cells, tests[-1:])
    return tests


def _kept(cells: list[tuple], tests: list[tuple[int, bool, int]]) -> list[tuple]:
    return [c for c in cells if all((c[k] >= i) == above for k, above, i in tests)]


def learn(labelled: DataFrame, bins: int = 16, most_rules: int = 8, most_tests: int = 3, precision: float = 0.9, support: int = 3) -> list[Rule]:
    """A decision list that rejects low quality, from statistics() rows with ``low`` (boolean).

    Rules come in the order learned. A rule needs the given precision on the part that it was pruned on, and so many
    rows there and in growing. Without rows of both kinds the list is empty.
    """
    sample = labelled.withColumn("fold", F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(3)) == 0)
    cells, edges = _cells(sample, bins)
    rules: list[Rule] = []
    while len(rules) < most_rules:
        growing, pruning = [c for c in cells if not c[-3]], [c for c in cells if c[-3]]
        tests = _grow(growing, edges, most_tests)
        worth = lambda some, among: (sum(c[-1] for c in _kept(among, some) if c[-2]), sum(c[-1] for c in _kept(among, some) if not c[-2]))
        value = lambda some: (lambda p, n: (p - n) / (p + n) if p + n else -1.0)(*worth(some, pruning))
        while len(tests) > 1 and value(tests[:-1]) >= value(tests):
            tests = tests[:-1]
        (p, n), (gp, gn) = worth(tests, pruning), worth(tests, growing)
        if not tests or p + gp < support or p < 1 or p < precision * (p + n) or gp < precision * (gp + gn):
            break
        rules.append(Rule(tuple((FEATURES[k], above, edges[FEATURES[k]][i - 1]) for k, above, i in tests), p / (p + n)))
        cells = [c for c in cells if not all((c[k] >= i) == above for k, above, i in tests)]
    return rules


def verdict(rules: list[Rule]) -> Column:
    """Number (from 1) of the first rule that rejects a row of statistics; null if none does."""
    out = F.lit(None).cast("int")
    for i in reversed(range(len(rules))):
        out = F.when(rules[i].condition(), F.lit(i + 1)).otherwise(out)
    return out


def quality(docs: DataFrame, labels: DataFrame, sample: int = 6_000) -> DataFrame:
    """statistics() of every document with ``rule`` (that rejects it, or null) and ``kept``.

    The list is learned from at most ``sample`` labelled documents, the first by a hash of doc_id; quality 0 is low,
    and rows with a null doc_id or quality don't count. Without usable labels ``kept`` is not base_failed. Repeated
    rows are judged alike, each once.
    """
    chosen = first_by_hash(labels.select(F.col("doc_id").cast("long"), "quality").dropna(), ["doc_id", "quality"], sample)
    chosen = chosen.select("doc_id", (F.col("quality") == 0).alias("low"))
    some = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # ``sample`` rows at most
    rules = learn(statistics(some).join(F.broadcast(chosen), "doc_id"))
    out = statistics(docs.select("doc_id", "text")).withColumn("rule", verdict(rules))
    return out.withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())


def op1_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    out = quality(docs, labels)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")
