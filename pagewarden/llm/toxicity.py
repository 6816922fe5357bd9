"""Severity of toxic language by cumulative-link ordinal regression over sparse text features.

Features are the words of a text, lower-cased and without outer punctuation, and the first four to seven letters of
longer ones (an insult keeps its stem when it is inflected); a feature's value is how often it stands there over the
square root of the text's words, so that a long text isn't severe for a stray word. P(severity > k) is a logistic
function of one weighted sum of features, shared by all grades, less the threshold of grade k; thresholds ascend. The
expected severity is the sum of these probabilities over k.

Of all features those are chosen whose texts are toxic too often for chance: an exact test, held against the number of
features tested, so that a small sample yields few features rather than wrong ones. Labels only tell toxic from clean,
so the grades of toxic sample texts are made from the sample: the share of words with chosen features, cut at its
quantiles.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from math import exp, lgamma, log, sqrt

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, IntegerType, StructField, StructType

from .common import first_by_hash, lean
from .token_ids import slices, trim

GRADES, STEMS, SCALE = 3, (4, 5, 6, 7), 4.0
_WORD = re.compile(r"[^\W_]+(?:['’-][^\W_]+)*")


def words_in(text: str | None) -> list[str]:
    """The words of a text in order; a null text has none."""
    return _WORD.findall((text or "").lower())


def features(word: str) -> list[str]:
    """A word and its stems, which are marked by a star."""
    return [word, *(f"{word[:n]}*" for n in STEMS if len(word) > n)]


@dataclass
class Model:
    words: dict[str, int]
    weights: np.ndarray
    thresholds: np.ndarray  #: ascending, one fewer than the grades 0 .. GRADES
    cut: float = 0.5  #: expected severity from which a text is rejected
    held_out: dict[str, float] = field(default_factory=dict)

    def __post_init__(self):
        self.starts = {w[: STEMS[0]] for w in self.words}

    def scores(self, texts: list[list[str]]) -> np.ndarray:
        """The weighted sums of features of texts given as their words."""
        out = np.zeros(len(texts))
        for i, words in enumerate(texts):
            # few words begin like a feature
            near = Counter(w for w in words if w[: STEMS[0]] in self.starts)
            for w, n in near.items():
                out[i] += n * sum(self.weights[self.words[x]] for x in features(w) if x in self.words)
            out[i] *= SCALE / sqrt(len(words)) if near else 0
        return out

    def severity(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(expected severity, most probable grade) of each text."""
        return self.of_scores(self.scores([words_in(t) for t in texts]))

    def of_scores(self, scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        above = _sigmoid(scores[:, None] - self.thresholds)
        each = -np.diff(np.hstack([np.ones((len(scores), 1)), above, np.zeros((len(scores), 1))]))
        return above.sum(axis=1), each.argmax(axis=1)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def ordinal_loss(theta: np.ndarray, rows: tuple[np.ndarray, np.ndarray, np.ndarray], over: np.ndarray, balance: np.ndarray, n_features: int, penalty: float) -> tuple[float, np.ndarray]:
    """The cumulative-link loss with a ridge penalty and its gradient.

    ``theta`` has the weights, the first threshold and the logarithms of the steps to the others; ``rows`` are (text,
    feature, value) of all values that aren't 0; ``over`` tells of each text and threshold whether its grade is above.
    """
    row, column, value = rows
    weights, steps = theta[:n_features], np.concatenate([theta[n_features : n_features + 1], np.exp(theta[n_features + 1 :])])
    margin = np.bincount(row, weights[column] * value, minlength=len(over))[:, None] - np.cumsum(steps)
    loss = float((balance * np.logaddexp(0, np.where(over > 0, -margin, margin))).sum() + penalty / 2 * (weights**2).sum())
    slope = (_sigmoid(margin) - over) * balance
    by_step = -np.cumsum(slope.sum(axis=0)[::-1])[::-1]
    by_weight = np.bincount(column, slope.sum(axis=1)[row] * value, minlength=n_features) + penalty * weights
    return loss, np.concatenate([by_weight, by_step[:1], by_step[1:] * steps[1:]])


def fit_ordinal(rows: list[dict[int, float]], grades: np.ndarray, n_features: int, n_grades: int, penalty: float = 0.001, rounds: int = 400, rate: float = 0.1) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ascending thresholds that minimise ordinal_loss(), by Adam, of texts given as values by features.

    Each threshold splits grades above it from the rest; both sides of a split weigh the same.
    """
    row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    column = np.array([k for r in rows for k in r], dtype=np.int64)
    value = np.array([v for r in rows for v in r.values()], dtype=float)
    over = (grades[:, None] > np.arange(n_grades)).astype(float)
    share = np.clip(over.mean(axis=0), 1e-3, 1 - 1e-3)
    balance = (over / share + (1 - over) / (1 - share)) / (2 * len(rows) * n_grades)
    theta = np.concatenate([np.zeros(n_features), [1.0], np.full(n_grades - 1, np.log(0.5))])
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for t in range(1, rounds + 1):
        _, gradient = ordinal_loss(theta, (row, column, value), over, balance, n_features, penalty)
        m, v = 0.9 * m + 0.1 * gradient, 0.999 * v + 0.001 * gradient**2
        theta = theta - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
    return theta[:n_features], np.cumsum(np.concatenate([theta[n_features : n_features + 1], np.exp(theta[n_features + 1 :])]))


def log_chance(toxic_with: int, texts_with: int, toxic: int, texts: int) -> float:
    """The logarithm of the chance that of ``texts_with`` random texts so many or more are toxic (hypergeometric tail)."""
    choose = lambda n, k: lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1)
    every = choose(texts, texts_with)
    terms = [choose(toxic, k) + choose(texts - toxic, texts_with - k) - every for k in range(max(toxic_with, texts_with - texts + toxic), min(texts_with, toxic, toxic_with + 60) + 1)]
    return max(terms) + log(sum(exp(t - max(terms)) for t in terms)) if terms else 0.0


def _feature_hash(x: str) -> int:
    raw = x.encode()
    return zlib.crc32(raw) << 31 | zlib.adler32(raw) >> 1


def counted(text: str | None) -> Counter:
    """How often each word stands in a text."""
    return Counter(words_in(text))


class Sample:
    """Labelled texts as counts of numbered words, in a few arrays however many words they have."""

    def __init__(self, vocabulary: pa.Array, bounds: np.ndarray, words: np.ndarray, times: np.ndarray, toxic: np.ndarray):
        self.vocabulary, self.bounds, self.words, self.times, self.toxic = vocabulary, bounds, words, times, toxic
        text = np.repeat(np.arange(len(toxic)), np.diff(bounds))
        self.total = np.maximum(1, np.bincount(text, times, minlength=len(toxic)))
        # 64-bit hashes stand for features: names of all would take far more room
        hashes = np.zeros((len(vocabulary), 1 + len(STEMS)), dtype=np.int64)
        for i, w in enumerate(vocabulary):
            own = [_feature_hash(x) for x in features(w.as_py())]
            hashes[i, : len(own)] = own
        known, numbers = np.unique(hashes, return_inverse=True)
        self.feature, self.n_features = numbers.reshape(hashes.shape).astype(np.int32), len(known)
        self.none = int(np.searchsorted(known, 0)) if len(known) and (hashes == 0).any() else -1  # stands for a stem that a word is too short for

    @classmethod
    def of(cls, texts: list[tuple[Counter | str | None, int]]) -> Sample:
        each = [x if isinstance(x, Counter) else counted(x) for x, _ in texts]
        coded = pa.array([w for x in each for w in x], pa.string()).dictionary_encode()
        return cls(coded.dictionary, np.concatenate([[0], np.cumsum([len(x) for x in each])]).astype(np.int64), coded.indices.to_numpy(), np.array([n for x in each for n in x.values()], dtype=np.int64), np.array([y for _, y in texts], dtype=bool))

    def of_text(self, i: int) -> slice:
        return slice(int(self.bounds[i]), int(self.bounds[i + 1]))

    def texts_with(self, texts: np.ndarray) -> np.ndarray:
        """In how many of these texts each feature stands."""
        out = np.zeros(self.n_features, dtype=np.int32)
        for i in texts:
            out[np.unique(self.feature[self.words[self.of_text(i)]])] += 1
        if self.none >= 0:
            out[self.none] = 0
        return out

    def has(self, texts: np.ndarray, chosen: np.ndarray) -> np.ndarray:
        """Whether each of these texts has a chosen feature."""
        told = np.zeros(self.n_features, dtype=bool)
        told[chosen] = True
        word = told[self.feature].any(axis=1)
        return np.array([word[self.words[self.of_text(i)]].any() for i in texts], dtype=bool)

    def names(self, chosen: np.ndarray) -> list[str]:
        order = np.argsort(chosen)
        out = [""] * len(chosen)
        for w, k in zip(*np.nonzero(np.isin(self.feature, chosen)), strict=True):
            i = order[np.searchsorted(chosen, self.feature[w, k], sorter=order)]
            out[i] = out[i] or features(self.vocabulary[int(w)].as_py())[k]
        return out


def telling(sample: Sample, toxic: np.ndarray, clean: np.ndarray, least_texts: int, doubt: float) -> np.ndarray:
    """Features of more toxic texts than by chance, the surest first; then those of the toxic texts that have none, and so on.

    The fewer toxic texts are left, the less likely it is that a feature is in several of them by chance.
    """
    in_clean, chosen = sample.texts_with(clean), np.zeros(0, dtype=np.int64)
    while len(toxic):
        number = sample.texts_with(toxic)
        tested = np.flatnonzero(number >= least_texts)
        most = log(doubt / max(1, len(tested)))
        some = tested[number[tested] / len(toxic) > 2 * in_clean[tested] / len(clean)]
        chance = np.array([log_chance(int(number[x]), int(number[x] + in_clean[x]), len(toxic), len(toxic) + len(clean)) for x in some])
        found = some[chance < most] if len(some) else some
        if not len(found):
            break
        chosen = np.concatenate([chosen, found[np.argsort(chance[chance < most], kind="stable")]])
        toxic = toxic[~sample.has(toxic, found)]
    return chosen


def train(sample: Sample | list[tuple[Counter | str | None, int]], grades: int = GRADES, most_words: int = 2_000, least_texts: int = 3, doubt: float = 0.05) -> Model | None:
    """A model from labelled texts (or their counted words); None if either kind is missing or no feature tells them apart.

    The last quarter is held out: on it the cut is chosen, and what the model does there is its ``held_out``. A cut that
    rejects more clean than toxic held-out texts is none. ``doubt`` is how many chosen features may be expected to be
    there by chance.
    """
    sample = sample if isinstance(sample, Sample) else Sample.of(sample)
    every = np.arange(len(sample.toxic))
    part, held = every[every % 4 != 3], every[every % 4 == 3]
    toxic = sample.toxic[part]
    if not toxic.any() or toxic.all():
        return None
    chosen = telling(sample, part[toxic], part[~toxic], least_texts, doubt)[:most_words]
    if not len(chosen):
        return None
    place = np.full(sample.n_features, -1, dtype=np.int32)
    place[chosen] = np.arange(len(chosen))
    told = (place[sample.feature] >= 0).any(axis=1)

    def values(i: int) -> dict[int, float]:
        own, out = sample.of_text(i), Counter()
        for w, n in zip(sample.words[own], sample.times[own], strict=True):
            if told[w]:
                out.update({int(x): int(n) for x in place[sample.feature[w]] if x >= 0})
        return {x: SCALE * n / sqrt(sample.total[i]) for x, n in out.items()}

    rows = {i: values(i) for i in every}
    density = np.array([sample.times[own][told[sample.words[own]]].sum() / sample.total[i] for i in part for own in [sample.of_text(i)]])
    cuts = np.quantile(density[toxic], [k / grades for k in range(1, grades)])
    y = np.where(toxic, 1 + (density[:, None] > cuts).sum(axis=1), 0)
    model = Model({w: i for i, w in enumerate(sample.names(chosen))}, *fit_ordinal([rows[i] for i in part], y, len(chosen), grades))
    # what a text without any chosen feature scores is not toxic, whatever the labels say of such texts
    model.cut = float(model.of_scores(np.zeros(1))[0][0]) + 0.1
    truth = sample.toxic[held]
    if truth.any() and not truth.all():
        severity = model.of_scores(np.array([sum(model.weights[x] * v for x, v in rows[i].items()) for i in held]))[0]
        best = -1.0
        for cut in np.arange(model.cut, grades, 0.05):
            above = severity >= cut
            hit, wrong, missed = (above & truth).sum(), (above & ~truth).sum(), (~above & truth).sum()
            f1 = 2 * hit / max(1, 2 * hit + wrong + missed)
            # of cuts that do alike, the one in the middle
            if f1 > best + 1e-9:
                best, low, high = f1, cut, cut
            elif abs(f1 - best) <= 1e-9 and cut - high < 0.06:
                high = cut
        model.cut = float((low + high) / 2)
        above = severity >= model.cut
        if (above & ~truth).sum() > (above & truth).sum():
            model.cut = float("inf")
        model.held_out = {"precision": float((above & truth).sum() / max(1, above.sum())), "recall": float((above & truth).sum() / truth.sum()), "texts": float(len(held))}
    return model


def labelled_sample(docs: DataFrame, labels: DataFrame, each: int = 3_000) -> Sample:
    """At most ``each`` toxic and as many clean labelled texts, the first by a hash of doc_id, in that order; equal ones once.

    Whole texts are counted by the executors; the driver gets the distinct words of each.
    """
    known = labels.select(F.col("doc_id").cast("long"), F.col("toxic").cast("int").alias("toxic")).dropna().withColumn("h", F.xxhash64("doc_id"))
    some = first_by_hash(known.where("toxic = 1"), ["doc_id"], each).union(first_by_hash(known.where("toxic = 0"), ["doc_id"], each))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                each_ = [sorted(counted(x).items()) for x in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("h", "doc_id", "toxic")), pa.array([[w for w, _ in x] for x in each_], pa.list_(pa.string())), pa.array([[n for _, n in x] for x in each_], pa.list_(pa.int32()))], names=["h", "doc_id", "toxic", "words", "times"])

    texts = docs.select(F.col("doc_id").cast("long"), "text").join(F.broadcast(some), "doc_id").select("h", "doc_id", "toxic", "text")  # 2 x ``each`` labels
    counted_ = texts.mapInArrow(lean(count), "h long, doc_id long, toxic int, words array<string>, times array<int>")
    once = counted_.withColumn("key", F.xxhash64("words", "times")).groupBy("key", "toxic").agg(F.min(F.struct("h", "doc_id", "words", "times")).alias("x")).select("x.*", "toxic")
    table = once.toArrow().sort_by([("h", "ascending"), ("doc_id", "ascending"), ("toxic", "ascending")])  # 2 x ``each`` texts
    words = table.column("words").combine_chunks()
    coded = pc.list_flatten(words).dictionary_encode()
    bounds = np.concatenate([[0], np.cumsum(pc.list_value_length(words).to_numpy(zero_copy_only=False))]).astype(np.int64)
    return Sample(coded.dictionary, bounds, coded.indices.to_numpy(), pc.list_flatten(table.column("times").combine_chunks()).to_numpy().astype(np.int64), table.column("toxic").to_numpy() == 1)


def severity(docs: DataFrame, labels: DataFrame, each: int = 3_000) -> DataFrame:
    """Adds expected_severity (0 to GRADES), grade and kept to the rows of a table with doc_id and text.

    The model is fitted by the driver on labelled_sample() and sent to the executors, with at most 2,000 words. A null
    or empty text scores like one without telling words. Without labels of both kinds, or if no feature tells them
    apart, all severities are 0 and all rows kept; an empty table stays empty. Texts may have any length. Repeated rows
    score alike; ties with the cut are rejected. Columns of ``docs`` that have the names of the new ones are replaced.
    """
    columns = [c for c in docs.columns if c not in ("expected_severity", "grade", "kept")]
    docs = docs.select(*[F.col(f"`{c}`") for c in columns])
    model = train(labelled_sample(docs, labels, each))
    trim()
    if model is None:
        return docs.withColumns({"expected_severity": F.lit(0.0), "grade": F.lit(0), "kept": F.lit(True)})

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                expected, grade = model.severity(part.column("text").to_pylist())
                out = {c: part.column(i) for i, c in enumerate(columns)} | {"expected_severity": expected, "grade": pa.array(grade, pa.int32()), "kept": pa.array(expected < model.cut)}
                yield pa.RecordBatch.from_arrays([pa.array(x) if isinstance(x, np.ndarray) else x for x in out.values()], names=list(out))



    schema = StructType([*docs.schema.fields, StructField("expected_severity", DoubleType()), StructField("grade", IntegerType()), StructField("kept", BooleanType())])
    return docs.mapInArrow(lean(score), schema)


def op9_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    scored = severity(docs.select("doc_id", "text"), labels)
    return scored.select("doc_id", "expected_severity", "grade", "kept")
