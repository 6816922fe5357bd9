"""One-permutation MinHash fingerprints with optimal densification and packed low-order bits.

Each five-word shingle is hashed once: the top bits choose a bin, the least hash of a bin stands for it. Sorting a
text's hashes puts the bins in order, so the first hash of each run is its bin's minimum. An empty bin takes the value
of another by a fixed random sequence of its own, so that equal sets fill it alike and different empty bins borrow
independently. Of each value the low bits are kept; likeness takes away what those bits agree on by chance.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import words_of

BINS, BITS, SHINGLE, PROBES = 128, 8, 5, 6


def _mixed(x: int) -> int:
    """A fixed 64-bit mix of a number, for the probe sequences."""
    x = (x + 0x9E3779B97F4A7C15) % 2**64
    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 % 2**64
    x = (x ^ x >> 27) * 0x94D049BB133111EB % 2**64
    return x ^ x >> 31


def with_fingerprint(df: DataFrame, text: str, out: str, bins: int = BINS, bits: int = BITS) -> DataFrame:
    """Adds ``out``, an array of ``bins`` numbers of ``bits`` bits, empty for a text without words; a null text is empty.

    A text of fewer than five words is one shingle. Equal texts have equal fingerprints.
    """
    shift, empty = 64 - (bins - 1).bit_length(), F.array().cast("array<bigint>")
    df = df.withColumn("_words", F.transform(words_of(F.col(text)), lambda w: F.xxhash64(w)))
    shingles = F.transform(F.sequence(F.lit(0), F.size("_words") - SHINGLE), lambda i: F.xxhash64(*[F.get("_words", i + k) for k in range(SHINGLE)]))
    whole = F.array(F.aggregate("_words", F.lit(0).cast("bigint"), lambda a, w: F.xxhash64(a, w)))
    df = df.withColumn("_hashes", F.when(F.size("_words") >= SHINGLE, F.sort_array(shingles)).when(F.size("_words") > 0, whole).otherwise(empty))
    bin_of = lambda h: F.shiftright(h, shift) + bins // 2
    least = F.filter("_hashes", lambda h, i: (i == 0) | (bin_of(h) != bin_of(F.get("_hashes", i - 1))))
    df = df.withColumn("_least", least)
    # a value for each bin: before each minimum as many nulls as bins were skipped, at the end the rest
    gap = lambda h, i: bin_of(h) - F.when(i == 0, F.lit(-1).cast("bigint")).otherwise(bin_of(F.get("_least", i - 1))) - 1
    none = F.lit(None).cast("bigint")
    padded = F.flatten(F.transform("_least", lambda h, i: F.concat(F.array_repeat(none, gap(h, i).cast("int")), F.array(h))))
    rest = F.array_repeat(none, (F.lit(bins - 1) - bin_of(F.element_at("_least", -1))).cast("int"))
    df = df.withColumn("_values", F.when(F.size("_least") == 0, empty).when(F.size("_least") == bins, F.col("_least")).otherwise(F.concat(padded, rest)))
    probes = [F.array(*[F.lit(_mixed(b * PROBES + t) % bins) for b in range(bins)]) for t in range(PROBES)]
    far = lambda b: F.array_min(F.transform("_least", lambda h: F.struct(F.xxhash64(b, bin_of(h)).alias("p"), h.alias("h"))))["h"]
    filled = F.transform("_values", lambda v, b: F.coalesce(v, *[F.get("_values", F.get(p, b)) for p in probes], far(b)))
    filled = F.when(F.size("_least") == bins, F.col("_values")).otherwise(filled)
    packed = F.transform(filled, lambda v: (v.bitwiseAND(F.lit(2**bits - 1))).cast("int"))
    return df.withColumn(out, packed).drop("_words", "_hashes", "_least", "_values")


def likeness(a: Column, b: Column, bits: int = BITS) -> Column:
    """Estimated Jaccard similarity (0 to 1) from two fingerprints; two empty ones are alike, an empty and another aren't."""
    same = F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda x: x)) / F.size(a)
    chance = 2.0**-bits
    corrected = F.greatest(F.lit(0.0), (same - chance) / (1 - chance))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(corrected)


def packed(values: Column) -> Column:
    """A fingerprint of eight-bit numbers as lower-case hexadecimal."""
    return F.lower(F.array_join(F.transform(values, lambda v: F.lpad(F.hex(v), 2, "0")), ""))


def _ranges(docs: DataFrame, rows_each: int, most: int, cuts: int = 2_000) -> tuple[Column, int]:
    """(number of the range of a row's doc_id, ascending with it, rows): ranges of about ``rows_each`` rows each.

    Quantiles of the ids cut the table into at most ``cuts`` spans of like many rows; each is cut into parts of equal
    width, so gaps between ids make no range large. Rows without doc_id are dealt over ranges below all others, by _tie.
    """
    n, nulls = docs.agg(F.count("doc_id"), F.count_if(F.col("doc_id").isNull())).first()
    parts = max(1, min(most, n // rows_each))
    spans = min(cuts, parts)
    at = docs.agg(F.percentile_approx("doc_id", [i / spans for i in range(spans + 1)], 100_000)).first()[0] or [0]
    at = sorted(set(at))
    each = max(1, parts // len(at))
    widths = [max(1.0, (float(y) - float(x)) / each) for x, y in zip(at, [*at[1:], at[-1] + 1], strict=True)]
    listed = lambda xs, kind: F.split(F.lit(",".join(map(str, xs))), ",").cast(f"array<{kind}>")  # noqa: E731  folded into a constant
    starts, steps = listed(at, "bigint"), listed(widths, "double")
    # the last start that isn't greater, by bisection; what lies below the first belongs to it
    half = lambda i, bit: F.when(F.coalesce(F.get(starts, i + bit) <= F.col("doc_id"), F.lit(False)), i + bit).otherwise(i)
    span = F.aggregate(F.array(*[F.lit(1 << k) for k in reversed(range(len(at).bit_length()))]), F.lit(0), half)
    # doubles may round two ids to one place but never change their order
    inner = F.greatest(F.lit(0), F.least(F.lit(each - 1), F.floor((F.col("doc_id").cast("double") - F.get(starts, F.col("_span")).cast("double")) / F.get(steps, F.col("_span")))))
    some = max(1, min(most, nulls // rows_each))
    below = F.floor((F.col("_tie").cast("double") / 2.0**64 + 0.5) * some) - some - 1
    return span, F.when(F.col("doc_id").isNull(), below).otherwise(F.col("_span").cast("long") * each + inner).cast("long")


def with_next(docs: DataFrame, columns: list[str], rows_each: int = 1_000, most: int = 65_536) -> DataFrame:
    """Adds next_<column>: the columns of the next document by descending doc_id; after the last comes the first.

    Documents are dealt over ranges of doc_id; each range also gets the first row of the range below it. Rows with
    the same doc_id follow each other by the first column's hash, a null doc_id comes last. At most ``most`` ranges, so
    that their table is small enough to broadcast.
    """
    order = [F.col("doc_id").desc_nulls_last(), F.col("_tie").desc()]
    tied = docs.withColumn("_tie", F.xxhash64(columns[0]))
    span, number = _ranges(docs.select("doc_id"), rows_each, most)
    tied = tied.withColumn("_span", span).withColumn("_range", number).drop("_span")
    top = tied.groupBy("_range").agg(F.max(F.struct(F.coalesce("doc_id", F.lit(-(2**63)).cast("long")).alias("d"), F.col("_tie").alias("t"))).alias("top"))
    above = Window.orderBy("_range")  # a row for each range
    last = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    top = top.withColumn("_to", F.coalesce(F.lead("_range").over(above), F.first("_range").over(last)))
    spread = tied.join(F.broadcast(top), "_range")
    is_top = (F.coalesce("doc_id", F.lit(-(2**63)).cast("long")) == F.col("top.d")) & (F.col("_tie") == F.col("top.t"))
    own = F.struct(F.col("_range").alias("r"), F.lit(0).alias("late"))
    spread = spread.withColumn("_places", F.when(is_top, F.array(own, F.struct(F.col("_to").alias("r"), F.lit(1).alias("late")))).otherwise(F.array(own)))
    spread = spread.drop("top", "_to", "_range").select("*", F.explode("_places").alias("_place")).select("*", F.col("_place.r").alias("_range"), F.col("_place.late").alias("_late")).drop("_places", "_place")
    after = Window.partitionBy("_range").orderBy("_late", *order)
    for c in columns:
        spread = spread.withColumn(f"next_{c}", F.lead(c).over(after))
    return spread.where("_late = 0").drop("_range", "_late", "_tie")


def op7_fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of each text and of its edited text, and their likeness.

    Edited: the last floor(n / 3) code points give way to the first as many of the next document. A null text is an
    empty one. Repeated rows are documents of their own, and follow each other; an empty table gives an empty result.
    doc_ids may lie anywhere; rows without one come after all others, by their texts' hashes. Texts may have any length;
    other columns aren't read.
    """
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    rows = with_fingerprint(rows, "text", "fp")
    rows = with_next(rows, ["text", "fp"])
    cut = F.floor(F.length("text") / 3).cast("int")
    rows = rows.withColumn("n_chars", F.length("text").cast("long"))
    rows = rows.withColumn("edited", F.concat(F.substring("text", F.lit(1), F.length("text") - cut), F.substring("next_text", F.lit(1), cut)))
    rows = rows.select("doc_id", "n_chars", "edited", F.sha2("edited", 256).alias("edited_sha256"), "fp", "next_fp")
    rows = with_fingerprint(rows, "edited", "edited_fp")
    return rows.select("doc_id", "n_chars", "edited_sha256", packed(F.col("fp")).alias("fingerprint"), packed(F.col("edited_fp")).alias("edited_fingerprint"), likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"), likeness(F.col("fp"), F.col("next_fp")).alias("near_next"))
