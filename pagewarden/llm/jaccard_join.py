"""Exact Jaccard join of n-gram sets by vertical partitioning.

The n-grams' global order (that of their hashes) is cut into fragments. First they screen the documents: a linked
document shares all its n-grams but a known number with another one, so the n-grams of the order's lower half are dealt
to buckets, each counts for every document the n-grams that others have too, and the counts are summed per document. Few
documents are left, of which the rest works on the sets alone.

Documents whose similarity reaches the threshold differ in so few n-grams that, among one fragment more than that, some
fragment is the same in both: its content's hash is the join key, so candidates come from fragments joined separately.
Candidates that hang together are gathered in units of bounded size; there each fragment's overlaps are counted on
their own and summed per pair.

There are a quarter more fragments than that, so linked documents share many of them; a document that shares fewer
fragments with all others together cannot be linked to any and is left out. Nor can two documents that share fewer, so
pairs that meet in rare fragments are counted, and those who meet by chance don't hang together; else, as the table
grows, chance would gather most documents in one cluster, whose pairs of blocks take space with the square of its size.

Sizes fall into classes; a document joins the fragments of its own class and of the next, so two documents of similar
size meet in one of them. A document so small that fragments stay empty is also joined on its prefix n-grams.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, kept_by_size, lean, ranked, released, salted, shuffled, stored
from .token_ids import slices
from .word_hashes import hashed, mixed, shingle_sets

WORDS, PERCENT = 4, 85
_UNIT_NGRAMS, _FRAGMENT = 1_000_000, 4_096
#: So many rows of documents in units, of about 100 bytes, are broadcast at most.
_FEW_PLACED = 100_000
#: A signature of more documents is frequent: these are joined with one of them only, not all with each other.
_FEW = 32
#: A set counts as so many n-grams at least when units are filled, so the matrix of a unit's pairs is bounded too.
_LEAST_WEIGHT = 700
#: In the screening: n-grams that a worker gathers into a block, n-grams of a bucket, buckets at most.
_BLOCK_NGRAMS, _BUCKET_NGRAMS, _MOST_BUCKETS = 2_000_000, 1_500_000, 1 << 17
#: N-grams below are counted. An owner's number in a block is less than _KNOWN, which marks n-grams of several owners.
_HALF, _KNOWN = np.uint64(1 << 63), 0xFFFF
_HEAD = np.dtype([("doc_id", "<i8"), ("valid", "?"), ("n", "<i8"), ("k1", "<i8"), ("k2", "<i8"), ("need", "<i8"), ("like", "<u2")])


@lru_cache(maxsize=4)
def _classes(percent: int) -> list[int]:
    """The least size of each class: two sets that can be linked are in the same or in neighbouring classes."""
    out = [1]
    while out[-1] < 2**31:
        out.append(max(out[-1] + 1, out[-1] * 100 // percent))
    return out


def _fragments(label: int, percent: int) -> tuple[int, int]:
    """(fragments of a class label, n-grams by which linked sets of that label may differ)."""
    most = _classes(percent)[min(label + 1, len(_classes(percent)) - 1)] - 1
    differ = (100 - percent) * 2 * most // (100 + percent)
    return differ + 2 + (differ + 1) // 4, differ


def signatures(ngrams: np.ndarray, percent: int) -> np.ndarray:
    """Join keys of a sorted set: hashes of (label, fragment, content) of its fragments that aren't empty."""
    out, size = [], len(ngrams)
    own = int(np.searchsorted(_classes(percent), size, side="right")) - 1
    content, short = mixed(ngrams), False
    for label in (own, own + 1):
        k, differ = _fragments(label, percent)
        fragment = ((ngrams >> np.uint64(32)) * np.uint64(k)) >> np.uint64(32)
        first = np.flatnonzero(np.concatenate([[True], fragment[1:] != fragment[:-1]]))
        with np.errstate(over="ignore"):
            total = np.add.reduceat(content, first) + (fragment[first] + np.uint64(label * 2**20)) * np.uint64(0x9E3779B97F4A7C15)
        out.append(mixed(total))
        short |= len(first) <= differ
    if short:
        prefix = size - -(-percent * size // 100) + 1
        out.append(mixed(ngrams[:prefix] ^ np.uint64(0xA5A5A5A5)))
    return np.concatenate(out)


def _key(ngrams: np.ndarray) -> tuple[int, int]:
    with np.errstate(over="ignore"):
        return int(mixed(ngrams).sum(dtype=np.uint64).astype(np.int64)), int(mixed(ngrams ^ np.uint64(0x5DEECE66D)).sum(dtype=np.uint64).astype(np.int64))


def least_shared(ngrams: np.ndarray, percent: int) -> int:
    """Fewer signatures in common with all other sets together mean that a sorted set is linked to none."""
    out, own = len(ngrams), int(np.searchsorted(_classes(percent), len(ngrams), side="right")) - 1
    for label in (own, own + 1):
        k, differ = _fragments(label, percent)
        fragment = ((ngrams >> np.uint64(32)) * np.uint64(k)) >> np.uint64(32)
        out = min(out, 1 + int((fragment[1:] != fragment[:-1]).sum()) - differ)
    return max(1, out)


def _owners(sigs: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Signatures with their owners, times and whether they are frequent.

    A signature of at most _FEW owners goes on with each of them. A frequent one goes on once, with one of its owners;
    the others share a key of their own with that one, counted. So a signature that very many documents have is sent on
    once for each slice of the input, not for each document.
    """
    order = np.lexsort((owner, sigs))
    sigs, owner = sigs[order], owner[order]
    fresh = np.concatenate([[True], (sigs[1:] != sigs[:-1]) | (owner[1:] != owner[:-1])])
    sigs, owner = sigs[fresh], owner[fresh]
    fresh = np.concatenate([[True], sigs[1:] != sigs[:-1]])
    nth, first = np.cumsum(fresh) - 1, np.flatnonzero(fresh)
    often = np.bincount(nth)[nth] > _FEW
    leader = owner[first[nth]]
    pairs, times = np.unique(np.stack([leader[often & ~fresh], owner[often & ~fresh]]), axis=1, return_counts=True)
    with np.errstate(over="ignore"):
        tied = mixed(mixed(pairs[0].astype(np.uint64)) * np.uint64(3) + pairs[1].astype(np.uint64))
    plain = ~often | fresh
    count = np.concatenate([np.ones(int(plain.sum()), dtype=np.int64), times, times]).astype(np.int32)
    return np.concatenate([sigs[plain], tied, tied]), np.concatenate([owner[plain], pairs[0], pairs[1]]), count, np.concatenate([often[plain], np.ones(2 * len(times), dtype=bool)])


def _met(sig: np.ndarray, ids: np.ndarray, times: np.ndarray, often: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Edges (pairs, times, whether a frequent signature makes them) of rows sorted by signature, which are whole groups.

    Owners of a frequent signature are each joined with the first one, those of another all with each other.
    """
    first = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]]))
    size = np.diff(np.concatenate([first, [len(sig)]]))
    strong = (np.add.reduceat(often.astype(np.int64), first) > 0) | (size > _FEW)
    row = np.arange(len(sig))
    lead = np.repeat(first, size)
    star = np.repeat(strong, size) & (row != lead)
    left, right, hot = [row[star]], [lead[star]], [np.ones(int(star.sum()), dtype=bool)]
    place, plain = row - lead, np.repeat(~strong, size)
    for back in range(1, int(size[~strong].max(initial=1))):
        at = row[plain & (place >= back)]
        left.append(at)
        right.append(at - back)
        hot.append(np.zeros(len(at), dtype=bool))
    left, right, hot = np.concatenate(left), np.concatenate(right), np.concatenate(hot)
    ends = np.stack([np.maximum(ids[left], ids[right]), np.minimum(ids[left], ids[right])])
    differ = ends[0] != ends[1]
    pairs, which = np.unique(ends[:, differ], axis=1, return_inverse=True)
    which = which.ravel()
    return pairs, np.bincount(which, times[left][differ], minlength=pairs.shape[1]).astype(np.int64), np.bincount(which, hot[differ], minlength=pairs.shape[1]) > 0


def overlaps(left: list[np.ndarray], right: list[np.ndarray] | None) -> np.ndarray:
    """Sizes of the intersections of all sets of left with all of right (None: with left), by fragments of their n-grams.

    N-grams of a single set can't overlap and are left out first.
    """
    sets = left if right is None else left + right
    flat = np.concatenate(sets) if sets else np.zeros(0, dtype=np.uint64)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    fresh = np.concatenate([[True], flat[1:] != flat[:-1]]) if len(flat) else np.zeros(0, dtype=bool)
    number = np.cumsum(fresh) - 1
    shared = np.bincount(number)[number] > 1 if len(flat) else fresh
    owner, number = owner[shared], number[shared]
    number = np.cumsum(np.concatenate([[False], number[1:] != number[:-1]])) if len(number) else number
    out = np.zeros((len(left), len(left if right is None else right)), dtype=np.float32)
    cuts = np.searchsorted(number, np.arange(0, int(number[-1]) + 1 + _FRAGMENT, _FRAGMENT)) if len(number) else []
    for a, b in zip(cuts, cuts[1:], strict=False):  # each fragment counts on its own, the counts of a pair add up
        present, row = np.unique(owner[a:b], return_inverse=True)
        has = np.zeros((len(present), _FRAGMENT), dtype=np.float32)
        has[row, number[a:b] - number[a]] = 1
        if right is None:
            out[np.ix_(present, present)] += has @ has.T
        else:
            mine = present < len(left)
            if mine.any() and not mine.all():
                out[np.ix_(present[mine], present[~mine] - len(left))] += has[mine] @ has[~mine].T
    return out


def _linked(left: list[np.ndarray], right: list[np.ndarray] | None, percent: int) -> np.ndarray:
    n, m = (np.array([len(s) for s in x], dtype=np.int64) for x in (left, left if right is None else right))
    both = np.rint(overlaps(left, right)).astype(np.int64)
    out = 100 * both >= percent * (n[:, None] + m - both)
    if right is None:
        np.fill_diagonal(out, False)
    return out


def _tree(linked: np.ndarray) -> list[tuple[int, int]]:
    """Pairs of a forest with the same components as a matrix of links (rows and columns are the same sets)."""
    out, todo = [], np.ones(len(linked), dtype=bool)
    for root in range(len(linked)):
        stack = [root] if todo[root] else []
        todo[root] = False
        while stack:
            x = stack.pop()
            near = np.flatnonzero(linked[x] & todo).tolist()
            todo[near] = False
            out += [(x, y) for y in near]
            stack += near
    return out


def _joined(column: pa.ChunkedArray, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """(all numbers in a binary column, how many each row has); a null row has none."""
    parts = [x.as_buffer() if x.is_valid else b"" for x in column]
    flat = [np.frombuffer(x, dtype=kind) for x in parts]
    return np.concatenate([np.zeros(0, dtype=kind), *flat]), np.array([len(x) for x in flat], dtype=np.int64)


class _Block:
    """Documents of a worker that are screened together."""

    def __init__(self, number: int):
        self.number, self.heads, self.sampled, self.at, self.like, self.size = number, [], [], [], {}, 0

    def add(self, doc_id: int, valid: bool, ngrams: np.ndarray, percent: int) -> None:
        n, place = len(ngrams), len(self.heads)
        k1, k2 = _key(ngrams)
        like = self.like.setdefault((n, k1, k2), place) if valid and n else place
        own = ngrams[: int(np.searchsorted(ngrams, _HALF))]
        # so many of the counted n-grams must be shared: the others, counted or not, are at most those that a link may lack
        need = len(own) - (100 - percent) * n // 100 if valid and n else 2**40
        self.heads.append((doc_id, valid, n, k1, k2, need, like))
        if like == place and valid and n:
            self.sampled.append(own)
            self.at.append(place)
            self.size += len(own)

    def rows(self, buckets: int) -> pa.RecordBatch:
        """Rows (SCREENED): each counted n-gram once, by buckets; those of several sets here count for these already."""
        heads = np.array(self.heads, dtype=_HEAD)
        flat = np.concatenate([np.zeros(0, dtype=np.uint64), *self.sampled])
        owner = np.repeat(np.array(self.at, dtype=np.uint16), [len(x) for x in self.sampled])
        bucket = ((flat >> np.uint64(31)) * np.uint64(buckets)) >> np.uint64(32)
        flat = bucket << np.uint64(32) | flat & np.uint64(0xFFFFFFFF)
        order = np.argsort(flat)
        flat, owner = flat[order], owner[order]
        fresh = np.concatenate([[True], flat[1:] != flat[:-1]]) if len(flat) else np.zeros(0, dtype=bool)
        first = np.flatnonzero(fresh)
        several = np.diff(np.concatenate([first, [len(flat)]])) > 1
        heads["need"] -= np.bincount(owner[several[np.cumsum(fresh) - 1]], minlength=len(heads)) if len(flat) else 0
        keys, owner = flat[first], np.where(several, _KNOWN, owner[first]).astype("<u2")
        bucket = (keys >> np.uint64(32)).astype(np.int32)
        cuts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(keys) else first
        low = keys.astype("<u4")  # the lower half
        ends = [*cuts[1:], len(keys)]
        own = [(int(bucket[a]), low[a:b].tobytes(), owner[a:b].tobytes(), None) for a, b in zip(cuts, ends, strict=False)]
        own.append((self.number % buckets, b"", b"", heads.tobytes()))
        bucket, low, owner, head = zip(*own, strict=True)
        return pa.RecordBatch.from_pydict({"bucket": pa.array(bucket, pa.int32()), "block": pa.array([self.number] * len(own), pa.int64()), "ngrams": pa.array(low, pa.binary()), "owners": pa.array(owner, pa.binary()), "heads": pa.array(head, pa.binary())})


SCREENED = "bucket int, block long, ngrams binary, owners binary, heads binary"


def screened(rows: DataFrame, words: int, percent: int) -> DataFrame:
    """Rows doc_id, n_shingles, k1, k2 (a key of the set) and able: false if the document is linked to no other text.

    A bucket meets each n-gram once for each block, so one that very many documents have makes no bucket large. Copies
    in different blocks count as different texts, so a text that has copies may be able because of them alone.
    """
    chars = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    buckets = int(min(_MOST_BUCKETS, max(32, chars // 12 // _BUCKET_NGRAMS)))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        block = _Block(number)
        for batch in batches:
            for part in slices(batch):
                hashes, offsets, _, _ = hashed(part.column("text"))
                ids, valid = pc.fill_null(part.column("doc_id"), 0).to_numpy(), np.asarray(part.column("doc_id").is_valid())
                for i, ngrams in enumerate(shingle_sets(hashes, offsets, words)):
                    block.add(int(ids[i]), bool(valid[i]), ngrams, percent)
                    if block.size >= _BLOCK_NGRAMS or len(block.heads) >= _KNOWN:
                        yield block.rows(buckets)
                        block = _Block(number := number + 1)
        yield block.rows(buckets)

    def count(table: pa.Table) -> pa.Table:
        ngrams, n = _joined(table.column("ngrams"), "<u4")
        owner, _ = _joined(table.column("owners"), "<u2")
        order = np.argsort(ngrams)
        ngrams, owner, row = ngrams[order], owner[order], np.repeat(np.arange(len(n), dtype=np.int32), n)[order]
        first = np.flatnonzero(np.concatenate([[True], ngrams[1:] != ngrams[:-1]])) if len(ngrams) else order
        times = np.diff(np.concatenate([first, [len(ngrams)]]))
        shared = (times > 1) | (owner[first] == _KNOWN)
        told = np.flatnonzero(np.repeat(shared, times) & (owner != _KNOWN))
        row, owner = row[told], owner[told]
        order = np.argsort(row, kind="stable")
        cuts = np.searchsorted(row[order], np.arange(len(n) + 1))
        owner = owner[order]
        return pa.table({"block": table.column("block"), "owners": pa.array([owner[a:b].tobytes() for a, b in zip(cuts, cuts[1:], strict=False)], pa.binary()), "heads": table.column("heads")})

    def decide(table: pa.Table) -> pa.Table:
        heads = np.concatenate([np.frombuffer(x.as_buffer(), dtype=_HEAD) for x in table.column("heads") if x.is_valid])
        owner, _ = _joined(table.column("owners"), "<u2")
        need = heads["need"] - np.bincount(owner, minlength=len(heads))
        return pa.table({"doc_id": pa.array(heads["doc_id"], pa.int64(), mask=~heads["valid"]), "n_shingles": heads["n"], "k1": heads["k1"], "k2": heads["k2"], "able": need[heads["like"]] <= 0})

    counted = rows.mapInArrow(lean(emit), SCREENED).groupBy("bucket").applyInArrow(lean(count), "block long, owners binary, heads binary")
    return counted.groupBy("block").applyInArrow(lean(decide), "doc_id long, n_shingles long, k1 long, k2 long, able boolean")


def jaccard_join(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """Links documents whose sets of ``words``-word shingles have a Jaccard similarity of ``percent`` / 100 or more.

    One row per row of (doc_id, text): doc_id, n_shingles, component_id (the least doc_id reachable by links, itself
    included) and n_links (documents that it is linked to). A-Z count as a-z. A text of fewer words is one shingle; a
    null text or one without words has no shingle and no link. Rows with the same doc_id and text are one document; of
    different texts with one doc_id, that with the least key of its set stands for the document. A row without doc_id
    has a null component and no links. Texts may have any length. An empty table gives an empty result; other columns
    aren't read.
    """
    rows = docs.select(F.col("doc_id").cast("long"), "text")
    spark = docs.sparkSession
    sizes = stored(screened(rows, words, percent), "sets")
    released(spark)
    real = sizes.where("n_shingles > 0 and doc_id is not null")
    several = real.groupBy("doc_id").agg(F.min(F.struct("k1", "k2")).alias("one"), F.max(F.struct("k1", "k2")).alias("other")).where("one <> other")
    several = stored(several.select("doc_id", "one"), "several")  # usually empty
    repeated = not several.isEmpty()
    if repeated:
        real = real.join(shuffled(several), "doc_id", "left").where(F.col("one").isNull() | (F.struct("k1", "k2") == F.col("one"))).drop("one")
    copies = real.groupBy("k1", "k2").agg(F.min("doc_id").alias("rep"), F.count_distinct("doc_id").alias("copies")).where("copies > 1")
    copies = stored(copies, "copies")
    wanted = salted(real.where("able").select("doc_id", "k1", "k2"), copies, ["k1", "k2"], "doc_id").where("rep is null or doc_id = rep")
    wanted = stored(wanted.select("doc_id", "k1", "k2").distinct(), "able")  # a document for each set

    def arrays(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                hashes, offsets, _, _ = hashed(part.column("text"))
                sets = shingle_sets(hashes, offsets, words)
                k = np.array([_key(s) for s in sets], dtype=np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_pydict({"doc_id": part.column("doc_id"), "k1": k[:, 0], "k2": k[:, 1], "n_shingles": pa.array([len(s) for s in sets], pa.int64()), "least": pa.array([least_shared(s, percent) if len(s) else 0 for s in sets], pa.int64()), "ngrams": pa.array([s.tobytes() for s in sets], pa.binary())})

    some = kept_by_size(rows, wanted.select("doc_id"), "doc_id", "left_semi").mapInArrow(lean(arrays), "doc_id long, k1 long, k2 long, n_shingles long, least long, ngrams binary")
    if repeated:
        some = some.join(shuffled(wanted), ["doc_id", "k1", "k2"], "left_semi")
    sets = stored(some, "ngrams")
    again = sets.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")  # rows with equal doc_id and text
    if not again.isEmpty():
        sets = stored(sets.dropDuplicates(["doc_id"]), "ngrams")

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (x.slice(n, 1_000) for x in batches for n in range(0, x.num_rows, 1_000)):
            found = [signatures(np.frombuffer(x.as_buffer(), dtype=np.uint64), percent) for x in batch.column("ngrams")]
            if not found:
                continue
            owner = np.repeat(batch.column("doc_id").to_numpy(), [len(s) for s in found])
            sigs, owner, times, often = _owners(np.concatenate(found), owner)
            yield pa.RecordBatch.from_pydict({"sig": sigs.view(np.int64), "doc_id": owner, "times": times, "often": often})

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = [np.zeros(0, dtype=t) for t in ("i8", "i8", "i4", "?")]  # of a group that may go on in the next batch
        for batch in chain(batches, [None]):
            new = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("sig", "doc_id", "times", "often")] if batch is not None else [x[:0] for x in kept]
            kept = [np.concatenate(x) for x in zip(kept, new, strict=True)]
            sig = kept[0]
            cut = int(np.searchsorted(sig, sig[-1])) if batch is not None and len(sig) else len(sig)
            whole, kept = [x[:cut] for x in kept], [x[cut:] for x in kept]
            if len(kept[0]) > 4 * _FEW:  # frequent, however it goes on: its first owner stands for those so far
                whole = [np.concatenate([x, y]) for x, y in zip(whole, kept, strict=True)]
                kept = [x[:1] for x in kept]
                kept[3] = np.ones(1, dtype=bool)
            if len(whole[0]):
                pairs, n, strong = _met(*whole)
                yield pa.RecordBatch.from_pydict({"a": pairs[0], "b": pairs[1], "n": n, "strong": strong})

    keyed = sets.select("doc_id", "ngrams").mapInArrow(lean(emit), "sig long, doc_id long, times int, often boolean").repartition("sig").sortWithinPartitions("sig", "doc_id")
    star = stored(keyed.mapInArrow(lean(meet), "a long, b long, n long, strong boolean").groupBy("a", "b").agg(F.sum("n").alias("n"), F.max("strong").alias("strong")), "star")
    shared = star.select(F.col("a").alias("doc_id"), "n").union(star.select("b", "n")).groupBy("doc_id").agg(F.sum("n").alias("n"))
    least = sets.select("doc_id", "least")
    able = sets.select("doc_id", "n_shingles", "least").join(shuffled(shared), "doc_id").where("n >= least").select("doc_id", "n_shingles")
    # two documents that no frequent signature joins have been counted in full, so chance meetings hold no cluster together
    weak = star.where("NOT strong").join(shuffled(least.toDF("a", "least_a")), "a").join(shuffled(least.toDF("b", "least_b")), "b").where("n >= greatest(least_a, least_b)")
    star = stored(star.where("strong").select("a", "b").union(weak.select("a", "b")), "edges")
    clusters = components(star.select("a", "b")).withColumnsRenamed({"node": "doc_id", "component": "cluster"})
    weights = stored(able.join(shuffled(clusters), "doc_id"), "clusters")
    weighed = weights.withColumn("h", F.xxhash64("doc_id")).withColumn("weight", F.greatest("n_shingles", F.lit(_LEAST_WEIGHT).cast("long")))
    placed = ranked(weighed, ["cluster"], "h", ["doc_id"], 64, "before", "weight")
    placed = placed.withColumn("block", F.floor(F.col("before") / _UNIT_NGRAMS).cast("int"))
    blocks = placed.groupBy("cluster").agg((F.max("block") + 1).alias("blocks"), F.sum("weight").alias("total"))
    blocks = stored(blocks, "blocks")
    total = int(blocks.agg(F.sum("total")).first()[0] or 0)
    shared_units = max(1, total // (2 * _UNIT_NGRAMS))
    one = F.pmod(F.xxhash64("cluster"), F.lit(shared_units))
    # a cluster of one block shares a unit with others; of several blocks, each pair of blocks is a unit
    placed = salted(placed.select("doc_id", "cluster", "block"), blocks.select("cluster", "blocks"), ["cluster"], "doc_id")
    placed = placed.select("doc_id", "cluster", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"), "blocks")
    unit = F.when(F.col("blocks") == 1, F.concat_ws(":", F.lit("s"), one)).otherwise(F.concat_ws(":", "cluster", F.least("block", "other"), F.greatest("block", "other")))
    placed = stored(placed.select("doc_id", "cluster", "block", "other", unit.alias("unit")), "units")
    copied = copies.select(F.col("rep").alias("doc_id"), "copies").dropDuplicates(["doc_id"])

    dealt = placed.join(shuffled(copied), "doc_id", "left")
    # few rows spare the n-grams a shuffle; a document has one for each block of its cluster
    dealt = F.broadcast(dealt) if placed.count() <= _FEW_PLACED else shuffled(dealt)
    full = sets.select("doc_id", "ngrams").join(dealt, "doc_id").select("unit", "cluster", "doc_id", "block", "other", "ngrams", F.coalesce("copies", F.lit(1)).alias("copies"))

    def link(table: pa.Table) -> pa.Table:
        frame = table.select(["cluster", "doc_id", "block", "other", "copies"]).to_pandas()
        sets = np.array([np.frombuffer(x.as_buffer(), dtype=np.uint64) for x in table.column("ngrams")] + [None], dtype=object)[:-1]
        a, b, links = [], [], []
        for _, own in frame.groupby("cluster", sort=True):
            low = np.minimum(own["block"], own["other"]).to_numpy()[0]
            high = np.maximum(own["block"], own["other"]).to_numpy()[0]
            ids, copies_of, block = own["doc_id"].to_numpy(), own["copies"].to_numpy(), own["block"].to_numpy()
            at = own.index.to_numpy()
            if low == high:
                near = _linked(list(sets[at]), None, percent)
                count = near @ copies_of
                pairs = _tree(near)
            else:
                left, right = np.flatnonzero(block == low), np.flatnonzero(block == high)
                across = _linked(list(sets[at[left]]), list(sets[at[right]]), percent)
                near = np.zeros((len(ids), len(ids)), dtype=bool)
                near[np.ix_(left, right)], near[np.ix_(right, left)] = across, across.T
                count = near @ copies_of
                pairs = _tree(near)
            a += [*ids.tolist(), *(int(ids[x]) for x, _ in pairs)]
            b += [*ids.tolist(), *(int(ids[y]) for _, y in pairs)]
            links += [*count.tolist(), *([0] * len(pairs))]
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "links": pa.array(links, pa.int64())})

    found = stored(full.groupBy("unit").applyInArrow(lean(link), "a long, b long, links long"), "links")
    joined = components(found.where("a <> b").select("a", "b"))
    links = found.where("a = b").groupBy("a").agg(F.sum("links").alias("links")).where("links > 0")
    classes = stored(links.select(F.col("a").alias("doc_id"), "links").join(shuffled(joined.withColumnRenamed("node", "doc_id")), "doc_id"), "classes")
    copies = copies.join(shuffled(classes.select(F.col("doc_id").alias("rep"), F.col("component").alias("far"), F.col("links").alias("far_links"))), "rep", "left")
    out = salted(sizes, copies, ["k1", "k2"], "doc_id").join(shuffled(classes), "doc_id", "left")
    component = F.when(F.col("n_shingles") > 0, F.coalesce("far", "rep", "component")).otherwise(F.lit(None))
    linked = F.when(F.col("n_shingles") > 0, F.coalesce("far_links", F.when(F.col("rep").isNull(), F.col("links")), F.lit(0)) + F.coalesce("copies", F.lit(1)) - 1).otherwise(0)
    return out.select("doc_id", "n_shingles", F.coalesce(component, F.col("doc_id")).alias("component_id"), linked.cast("long").alias("n_links"))


def op10_jaccard_join(docs: DataFrame) -> DataFrame:
    return jaccard_join(docs)
