import hashlib
import random
import re
from collections import Counter
from itertools import combinations

import corpus_pipeline
import numpy as np
import pyarrow as pa
import pytest
from pagewarden.llm import common, fingerprints, jaccard_join, mixing, packing, passages, pfor, quality, sharding, toxicity, warc
from pagewarden.llm.token_ids import Encoder, crc32, default_vocabulary
from pyspark.sql import functions as F

WORDS = [f"w{i}" for i in range(300)]
DOCS = "doc_id long, text string"


def prose(seed, n=120):
    return " ".join(random.Random(seed).choices(WORDS, k=n))


@pytest.fixture(scope="module")
def texts():
    base = [prose(i) for i in range(12)]
    near = [base[0].replace(base[0].split()[60], "edited", 1), base[1] + " more"]
    odd = ["", None, " \n\t", "one", base[2], base[2], "#x " * 40, "é" * 50, prose(99, 5000)]
    return list(enumerate([*base, *near, *odd, " ".join([prose(7, 30), base[3], prose(8, 40)])]))


@pytest.fixture(scope="module")
def docs(spark, texts):
    return spark.createDataFrame(texts, DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def test_encoder_equals_library():
    rng, parts = random.Random(3), ["a", "b", " ", "\n", "  ", "\t", "é", "'s", "x.", "<|endoftext|>", "\r\n", "\x01", "日本", " ", "\x85"]
    own = ["".join(rng.choices(parts, k=rng.randint(0, 9))) for _ in range(3000)] + ["a\nb c. d"]
    e = Encoder(default_vocabulary())
    flat, at = e.encode(pa.array(own))
    assert [flat[a:b].tolist() for a, b in zip(at, at[1:])] == e._plain(own)


@pytest.mark.parametrize("n", [0, 1, 255, 256, 257, 3000])
def test_blocks_round_trip(n):
    rng = np.random.default_rng(n)
    ids = np.where(rng.random(n) < 0.05, rng.integers(0, 2**32, n), rng.integers(0, 300, n)).astype(np.uint32)
    data = pfor.encode_file(np.array([7]), np.array([n]), ids)
    assert (pfor.decode_file(data)[2] == ids).all() and (pfor.read_range(data, n // 3, 50) == ids[n // 3 :][:50]).all()


def test_token_files(docs, none, texts):
    e, at = Encoder(default_vocabulary()), 0
    got = {r.doc_id: r for r in pfor.op4_token_ids(docs).collect()}
    for i, t in texts:
        ids = [*e._plain([t or ""])[0], 0]
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (at, len(ids), crc32(np.array(ids)))
        at += len(ids)
    assert pfor.op4_token_ids(none).count() == 0


def test_packing(docs, none):
    rows = packing.pack(docs, 256).toPandas().sort_values(["sequence_id", "offset"])
    by = rows.groupby("sequence_id")
    assert (by.length.cumsum() - rows.length == rows.offset).all() and by.length.sum().max() <= 256
    assert by.ngroups <= -(-rows.length.sum() // 256) + 2 and packing.pack(none).count() == 0


def test_plan_uses_every_piece():
    rng = random.Random(1)
    histogram = Counter(rng.choice([rng.randint(1, 2047), rng.randint(1, 300), 2048]) for _ in range(5000))
    made = Counter()
    for shape, n in packing.plan(histogram):
        assert sum(shape) <= 2048
        for x in shape:
            made[x] += n
    assert made == histogram


def test_nnls():
    a, x = np.array([[1.0, 0, 1], [0, 1, 1], [1, 1, 0]]), np.array([2.0, 0, 3])
    assert np.allclose(packing.nnls(a, a @ x), x)


def test_warc(spark):
    long = "x" * 200
    rows = [(5, "http://a/5", long), (2, "http://a/\r\n2", long), (3, None, "short"), (4, "u", "short"), (6, "u", None), (None, "u", long)]
    got = {r.page_id: r for r in warc.op5_warc(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert (got[5].record_type, got[5].refers_to, got[5].payload_bytes) == ("revisit", 2, 200)
    assert {got[i].record_type for i in (2, 3, 4, 6, None)} == {"response"} and got[6].payload_bytes == 0


def test_warc_dictionary(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"http://a/{i}", prose(i, 200)) for i in range(60)], "page_id long, url string, html string")
    warc.write_warc(rows, f"file://{tmp_path}").collect()
    assert any(f.read_bytes()[:4] == b"\x5d\x2a\x4d\x18" for f in tmp_path.glob("*.zst"))
    assert {r.payload for r in warc.read_warc(spark, f"file://{tmp_path}", True).collect()} == {prose(i, 200) for i in range(60)}


def test_warc_lists_archives_in_few_files(spark, monkeypatch):
    pages, lists = spark.createDataFrame([(i, f"u{i}", prose(i % 150)) for i in range(300)], "page_id long, url string, html string"), []
    monkeypatch.setattr(warc, "stored", lambda df, kind: lists.append(common.stored(df, kind)) or lists[-1])
    more = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in more}
    try:
        for k, v in more.items():
            spark.conf.set(k, v)
        rows = warc.op5_warc(pages).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert len(lists[0].inputFiles()) <= 4 < lists[0].count() and lists[0].agg(F.sum("n_records")).first()[0] == 300
    assert sorted((r.page_id, r.refers_to) for r in rows) == [(i, i - 150 if i >= 150 else None) for i in range(300)]


def test_mixing_stays_within_a_block(spark):
    share = mixing.shares({"a": 5, "b": 3, "c": 1, "d": 0.1}, 1000)
    slots = mixing.one_cycle(share)
    for s, at in slots.items():
        for t in range(1000):
            assert abs(sum(x <= t for x in at) - (t + 1) * share[s] / 1000) < 1
    rows = spark.createDataFrame([(i, "big" if i % 3 else None if i % 2 else "small") for i in range(500)], "doc_id long, source string")
    out = mixing.mix(rows, {"big": 1, "small": 1, None: 2}, block_rows=4, cycle=100)
    assert sorted(r.position for r in out.collect()) == list(range(500)) and mixing.mix(rows.limit(0)).count() == 0


def test_sharding(docs, none, texts):
    rows = sharding.shard(docs, 4).toPandas()
    sizes = rows.groupby("shard").size()
    assert sizes.max() - sizes.min() <= 1 and all(sorted(x.slot) == list(range(len(x))) for _, x in rows.groupby("shard"))
    assert sharding.shard(none).count() == 0 and rows[rows.doc_id.isin([2, 18, 19])].shard.nunique() == 1


def test_sharding_of_one_large_group(spark):
    rows = sharding.shard(spark.createDataFrame([(i, "same" if i % 2 else str(i)) for i in range(200)], DOCS), 8).toPandas()
    assert rows.groupby("shard").size().tolist() == [25] * 8 and rows[rows.doc_id % 2 == 1].shard.nunique() <= 5


def shingles(t, n):
    w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def test_fingerprints(docs, none, texts):
    got = {r.doc_id: r for r in fingerprints.op7_fingerprints(docs).collect()}
    assert got[18].fingerprint == got[19].fingerprint == got[2].fingerprint
    order = sorted(dict(texts), reverse=True)
    for n, i in enumerate(order):
        a, b = (shingles(dict(texts)[x], 5) for x in (i, order[(n + 1) % len(order)]))
        assert abs(got[i].near_next - (len(a & b) / len(a | b) if a | b else 1)) < 0.2
    assert fingerprints.op7_fingerprints(none).count() == 0


def test_jaccard_join(docs, none, texts):
    got = {r.doc_id: r for r in jaccard_join.jaccard_join(docs).collect()}
    sets = {i: shingles((t or "").lower(), 4) for i, t in texts}
    for i, a in sets.items():
        near = [j for j, b in sets.items() if i != j and a and b and 100 * len(a & b) >= 85 * len(a | b)]
        assert got[i].n_shingles == len(a) and got[i].n_links == len(near) and got[i].component_id == min([i, *near])
    assert jaccard_join.jaccard_join(none).count() == 0


def near_classes(sets, percent):
    """Links and the least id of each component, by brute force over all pairs."""
    links = {i: [j for j, b in sets.items() if i != j and a and b and 100 * len(a & b) >= percent * len(a | b)] for i, a in sets.items()}
    least = {i: i for i in sets}
    while any(least[i] != min(least[j] for j in [i, *links[i]]) for i in sets):
        least = {i: min(least[j] for j in [i, *links[i]]) for i in sets}
    return links, least


def edited_chain(n=40):
    """Texts of which each differs from the one before in two words, so that only the nearest are linked; then a copy of the first."""
    rng, words = random.Random(5), prose(5, 200).split()
    out = []
    for i in range(n):
        out.append((i, " ".join(words)))
        for _ in range(2):
            words[rng.randrange(200)] = f"new{i}"
    return [*out, (n, out[0][1]), (n + 1, prose(6, 200)), (n + 2, "a b"), (n + 3, None)]


def test_jaccard_join_keeps_chance_meetings_apart(spark, monkeypatch):
    word = lambda *x: "w" + hashlib.md5(repr(x).encode()).hexdigest()[:8]
    # each text has a near copy, and half of its words in common with the text before
    passages_ = [[word(i, n) for n in range(75)] for i in range(31)]
    texts = [passages_[i] + passages_[i + 1] for i in range(30)]
    rows = [(2 * i + k, " ".join(x[: len(x) - k])) for i, x in enumerate(texts) for k in range(2)]
    kept, stored = {}, jaccard_join.stored
    monkeypatch.setattr(jaccard_join, "stored", lambda df, kind="table": kept.setdefault(kind, stored(df, kind)))
    got = {r.doc_id: (r.component_id, r.n_links) for r in jaccard_join.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {n: (n - n % 2, 1) for n in range(60)}
    assert kept["clusters"].select("cluster").distinct().count() == 30


def test_jaccard_join_edges_of_signatures_over_batches(monkeypatch):
    monkeypatch.setattr(jaccard_join, "_FEW", 3)
    sigs, owner = np.array([7] * 5 + [8] * 3 + [9] * 2, dtype=np.uint64), np.array([1, 2, 3, 4, 5, 1, 2, 3, 4, 4])
    sig, ids, times, often = jaccard_join._owners(sigs, owner)
    order = np.lexsort((ids, sig))
    pairs, n, strong = jaccard_join._met(sig[order].view(np.int64), ids[order], times[order], often[order])
    assert {(int(a), int(b)): (int(c), bool(d)) for a, b, c, d in zip(*pairs, n, strong)} == {(2, 1): (2, True), (3, 1): (2, True), (4, 1): (1, True), (5, 1): (1, True), (3, 2): (1, False)}


def test_jaccard_join_of_a_cluster_in_many_units(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "_UNIT_NGRAMS", 2_000)  # three or so documents a block
    rows = edited_chain()
    got = {r.doc_id: r for r in jaccard_join.jaccard_join(spark.createDataFrame(rows, DOCS)).collect()}
    links, least = near_classes({i: shingles((t or "").lower(), 4) for i, t in rows}, 85)
    assert max(map(len, links.values())) > 2 and len(got) == len(rows)
    assert {i: (r.n_links, r.component_id) for i, r in got.items()} == {i: (len(links[i]), least[i]) for i in links}


def test_pipeline_drops_near_copies_only(spark):
    rows = edited_chain(12)
    docs = spark.createDataFrame([(i, t, "en", "web", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    _, least = near_classes({i: shingles((t or "").lower(), 5) for i, t in rows}, 80)
    kept = corpus_pipeline.drop_near_copies(spark, docs, "")
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i in least if least[i] == i)


def test_pipeline_keeps_documents_without_or_with_repeated_ids(spark):
    a, b, c, d, e = (prose(7000 + i, 100) for i in range(5))
    rows = [(None, a), (None, b), (None, None), (1, c), (1, c), (1, d), (1, None), (2, e), (3, e + " more"), (4, d + " more"), (5, c)]
    docs = spark.createDataFrame([(i, t, "en", "web", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = [(r.doc_id, r.text) for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect()]
    left = {(None, a), (None, b), (None, None), (1, None), (2, e)}
    assert left <= set(kept) and len(kept) == len(left) + 2
    # one of each group of near copies, whichever of the texts of doc_id 1 has the number of its own
    assert len({(1, c), (5, c)} & set(kept)) == 1 and len({(1, d), (4, d + " more")} & set(kept)) == 1


def test_overlaps_by_blocks():
    rng = np.random.default_rng(0)
    sets = [np.unique(rng.integers(0, 400, 100).astype(np.uint64)) for _ in range(20)]
    want = [[len(np.intersect1d(a, b)) for b in sets] for a in sets]
    apart = ~np.eye(20, dtype=bool)  # a set's overlap with itself isn't asked for
    assert (jaccard_join.overlaps(sets, None) == want)[apart].all() and (jaccard_join.overlaps(sets[:7], sets[7:]) == np.array(want)[:7, 7:]).all()


def test_passages(docs, none):
    got = passages.op3_passages(docs).toPandas()
    whole = got[(got.doc_id == 23)]
    assert whole.partner_id.tolist() == [3] and abs(whole.start_word.iloc[0] - 30) <= 1 and abs(whole.end_word.iloc[0] - 150) <= 1
    assert {(a, b) for a, b in zip(got.doc_id, got.partner_id)} >= {(12, 0), (13, 1), (18, 2), (19, 2)} and not set(got.doc_id) & set(range(12))
    assert passages.op3_passages(none).count() == 0


def changed(words, every, how, seed):
    """Words of which one in ``every`` is substituted, deleted or has a new one after it."""
    rng, out = random.Random(seed), []
    for n, x in enumerate(words):
        kind = rng.choice(how) if n % every == every // 2 else ""
        out += {"": [x], "substitute": [f"s{seed}.{n}"], "insert": [x, f"i{seed}.{n}"], "delete": []}[kind]
    return out


def matched_words(a, b):
    """Words of the best alignment of two texts, by brute force."""
    row = [0] * (len(b) + 1)
    for x in a:
        up, row = row, [0]
        for j, y in enumerate(b):
            row.append(up[j] + 1 if x == y else max(up[j + 1], row[j]))
    return row[-1]


def test_passages_with_changed_words(spark):
    rows, want = [], {}
    kinds = [(60, 10, ["substitute"]), (60, 6, ["substitute"]), (80, 5, ["substitute"]), (60, 10, ["substitute", "insert", "delete"]), (80, 8, ["insert"]), (80, 8, ["delete"])]
    for i in range(60):
        n, every, how = kinds[i % len(kinds)]
        own = [f"{i}.{w}" for w in prose(i, n).split()]
        other = changed(own, every, how, i)
        rows += [(i, " ".join([prose(1000 + i, 40), *own, prose(2000 + i, 40)])), (1000 + i, " ".join([prose(3000 + i, 40), *other, prose(4000 + i, 40)]))]
        if matched_words(own, other) >= 0.8 * max(len(own), len(other)):
            want[1000 + i, i] = other
    found = {(r.doc_id, r.partner_id): r for r in passages.repeated_passages(spark.createDataFrame(rows, DOCS)).collect()}
    assert len(want) > 50 and found.keys() == want.keys()
    for pair, other in want.items():
        assert found[pair].start_word <= 46 and found[pair].end_word >= 40 + len(other) - 6 and found[pair].identity >= 0.8


@pytest.mark.parametrize(("parts", "n"), [(2, 30), (3, 20), (5, 12)])
def test_passages_whose_lines_occurred_before(spark, parts, n):
    rows = []
    for t in range(12):
        lines = [" ".join(f"{t}.{w}" for w in prose(100 * t + q, n).split()) for q in range(parts)]
        # each line alone in documents before and between the two that have all of them
        rows += [(e * 1000 + 10 * t + q, " ".join([prose(f"{e} {t} {q}", 30), line, prose(f"{e} {q} {t}", 30)])) for e in (0, 2) for q, line in enumerate(lines)]
        rows += [(e * 1000 + 10 * t, " ".join([prose(f"{e} {t}", 30), *lines, prose(f"{e} {t} end", 30)])) for e in (1, 3)]
    cover = {}
    for r in passages.repeated_passages(spark.createDataFrame(rows, DOCS)).collect():
        cover.setdefault(r.doc_id, set()).update(range(r.start_word, r.end_word))
    assert cover.keys() == {3000 + 10 * t for t in range(12)} and all(set(range(30, 30 + parts * n)) <= x for x in cover.values())


def test_passages_of_chance_meetings_are_not_aligned(spark, monkeypatch):
    """A near copy's seeds are hits, but not with a third text that has one of them; a pair with a line in common is dropped by bytes of its words."""
    stored, pairs = passages.stored, {}

    def kept(df, kind="table"):
        out = stored(df, kind)
        pairs[kind] = {tuple(r) for r in out.select("doc_id", "partner_id").collect()} if "chains" in out.columns else None
        return out

    monkeypatch.setattr(passages, "stored", kept)
    new = iter(range(10**6))
    fresh = lambda n: [f"w{next(new)}" for _ in range(n)]
    copied, line = fresh(200), fresh(14)
    texts = {1: fresh(90) + copied[50:54] + fresh(90), 2: copied, 3: [*copied, *fresh(3)], 4: fresh(90) + line + fresh(90), 5: fresh(70) + line + fresh(95)}
    got = passages.repeated_passages(spark.createDataFrame([(i, " ".join(x)) for i, x in texts.items()], DOCS)).collect()
    assert [(r.doc_id, r.partner_id, r.start_word, r.end_word) for r in got] == [(3, 2, 0, 200)]
    assert pairs["chains"] == {(3, 2), (5, 4)} and pairs["likely"] == {(3, 2)}


def test_backed_by_the_places_around():
    """Seven seeds within 47 places: frequent ones count for every partner, others for their own."""
    at = np.arange(100, 107)
    hits = lambda partner, frequent, n=7: (np.full(n, 9), np.full(n, partner), at[:n], np.full(n, frequent))
    one = (np.array([9, 9]), np.array([1, 1]), np.array([120, 200]), np.zeros(2, dtype=bool))
    backed = lambda *x: passages.backed(*(np.concatenate(y) for y in zip(*x, strict=True)), 7, 47)[: len(x[0][0])].tolist()
    assert backed(one, hits(2, False)) == [False, False]
    assert backed(one, hits(2, True)) == [True, False] == backed(one, hits(1, False))
    assert backed(one, hits(2, True, 6)) == [True, False] and backed(one, hits(2, True, 5)) == [False, False]
    assert backed((at[:0],) * 3 + (at[:0] > 0,)) == []


def test_bytes_of_words_leave_out_no_pair():
    """Excerpts of 150 words, some of them with a passage of 50 with changed words: what whole words keep, their low bytes keep."""
    rng, rows = np.random.default_rng(5), []
    for n in range(400):
        a, b = rng.integers(0, 2**32, (2, 150), dtype=np.uint32)
        if n % 2:
            b[48:98] = a[50:100]
            b[48 + rng.choice(50, n % 23, replace=False)] = 7
        rows.append((a, b))
    batch = lambda kind: pa.RecordBatch.from_pydict({"chains": pa.array([[[70, 68, 4]]] * len(rows), pa.list_(pa.list_(pa.int32()))), "from": pa.array([0] * len(rows), pa.int32()), "other_from": pa.array([0] * len(rows), pa.int32()), "mine": pa.array([a.astype(kind).tobytes() for a, _ in rows], pa.binary()), "other": pa.array([b.astype(kind).tobytes() for _, b in rows], pa.binary())})
    whole, low = passages.hopeful(batch("<u4"), 50, 0.8), passages.hopeful(batch("u1"), 50, 0.8, kind="u1")
    assert whole.sum() > 100 and not (whole & ~low).any() and low[::2].sum() < 5


def test_cutting(spark):
    own = spark.createDataFrame([(1, "a  b\nc d", 8), (2, "a b", 3), (3, None, 0)], "doc_id long, text string, n_chars long")
    spans = spark.createDataFrame([(1, 1, 3), (1, 2, 3), (2, 0, 2)], "doc_id long, start_word int, end_word int")
    assert {(r.doc_id, r.text, r.n_chars) for r in passages.without_passages(own, spans).collect()} == {(1, "a   d", 5), (3, None, 0)}


def test_quality(spark, docs, texts):
    labels = spark.createDataFrame([(i, 1) for i in range(12)], "doc_id long, quality int")
    got = {r.doc_id: r for r in quality.op1_quality(docs, labels).collect()}
    for i, t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        runs = [tuple(w[k : k + 5]) for k in range(len(w) - 4)]
        count, cover = Counter(runs), set()
        for k, x in enumerate(runs):
            if count[x] > 1:
                cover |= set(range(k, k + 5))
        assert (got[i].n_words, got[i].n_repeat_words, got[i].n_symbols) == (len(w), len(cover), len(re.findall(r"[#*$%&|<>]", t or "")))
    assert got[0].kept and not got[18 - 4].kept


def test_decision_list_learns(spark):
    rows = [(i, prose(i) if i % 3 else " ".join(w + "##" for w in prose(i).split())) for i in range(300)]
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 1) for i in range(300)], "doc_id long, quality int, rule int")
    out = quality.quality(spark.createDataFrame(rows, DOCS), labels)
    assert out.where(F.col("kept") != (F.col("doc_id") % 3 > 0)).count() == 0


def test_toxicity_held_out():
    clean = [(prose(i, 60), 0) for i in range(400)]
    toxic = [(f"{prose(1000 + i, 60)} {' '.join(['vilefolk'] * (1 + i % 4))}", 1) for i in range(100)]
    sample = clean + toxic
    random.Random(0).shuffle(sample)
    model = toxicity.train(sample)
    assert model.held_out["precision"] > 0.95 and model.held_out["recall"] > 0.95 and (np.diff(model.thresholds) > 0).all()
    severity, _ = model.severity([None, "", "vilefolk"])
    assert severity[0] == severity[1] < severity[2]


def test_toxicity_without_labels(spark, docs):
    out = toxicity.op9_toxicity(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert out.where("kept").count() == docs.count()


def test_ordinal_gradient_equals_numeric_differences():
    rng = np.random.default_rng(4)
    rows = (rng.integers(0, 30, 80), rng.integers(0, 6, 80), rng.random(80))
    over = (rng.integers(0, 4, 30)[:, None] > np.arange(3)).astype(float)
    balance, theta = rng.random((30, 3)), rng.normal(size=9)
    _, gradient = toxicity.ordinal_loss(theta, rows, over, balance, 6, 0.1)
    for i in range(9):
        step = np.eye(9)[i] * 1e-6
        up, down = (toxicity.ordinal_loss(theta + d, rows, over, balance, 6, 0.1)[0] for d in (step, -step))
        assert abs((up - down) / 2e-6 - gradient[i]) < 1e-5


def test_log_chance_equals_the_count_of_draws():
    for toxic_with, texts_with, toxic, texts in [(3, 4, 5, 20), (0, 3, 4, 9), (4, 4, 4, 30), (2, 9, 3, 10)]:
        every = [sum(x < toxic for x in drawn) for drawn in combinations(range(texts), texts_with)]
        assert abs(np.exp(toxicity.log_chance(toxic_with, texts_with, toxic, texts)) - np.mean([n >= toxic_with for n in every])) < 1e-9


def test_toxicity_of_few_labels_rejects_nothing(spark):
    rows = [(i, prose(i, 40)) for i in range(40)]
    labels = spark.createDataFrame([(i, int(i < 4)) for i in range(40)], "doc_id long, toxic int")
    assert toxicity.op9_toxicity(spark.createDataFrame(rows, DOCS), labels).where("kept").count() == 40


def test_toxicity_of_inflected_words_and_long_texts(spark):
    """Insults with endings of their own are known by their stems; a stray one in a very long text is no toxic text."""
    rng = random.Random(8)
    insult = lambda: "grumbel" + "".join(rng.choices("aeiouns", k=3))
    rows = [(i, f"{prose(i, 80)} {insult()} {insult()} {insult()}" if i % 5 == 0 else prose(i, 80)) for i in range(600)]
    rows += [(1000, prose(1000, 300_000)), (1001, f"{insult()} {prose(1001, 20_000)}"), (1002, f"{prose(1, 40)} {insult()} {insult()}"), (1003, None), (1004, "")]
    docs = spark.createDataFrame([(i, t, 1.0, True) for i, t in rows], "doc_id long, text string, expected_severity double, kept boolean")
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(600)], "doc_id long, toxic int")
    out = toxicity.severity(docs, labels)
    kept = {r.doc_id: r.kept for r in out.collect()}
    assert len(out.columns) == 5 and len(kept) == len(rows)
    assert not kept[1002] and all(kept[i] for i in (1000, 1001, 1003, 1004)) and sum(kept[i] != (i % 5 > 0) for i in range(600)) <= 2


def edited(text, following):
    cut = len(text) // 3
    return text[: len(text) - cut] + following[:cut]


def brute_fingerprints(spark, rows):
    """Holds op7 against Python over (doc_id, text) with distinct texts; ids may be null or far apart."""
    texts = {t or "": i for i, t in rows}
    got = fingerprints.op7_fingerprints(spark.createDataFrame(rows, DOCS)).collect()
    tie = {r.text: r.h for r in spark.createDataFrame([(t,) for t in texts], "text string").select("text", F.xxhash64("text").alias("h")).collect()}
    order = sorted(texts, key=lambda t: (texts[t] is not None, texts[t] or 0, tie[t]), reverse=True)
    want = Counter()
    for n, t in enumerate(order):
        want[texts[t], len(t), hashlib.sha256(edited(t, order[(n + 1) % len(order)]).encode()).hexdigest()] += 1
    assert Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in got) == want


def test_fingerprints_of_far_and_missing_ids(spark, monkeypatch):
    near = fingerprints.with_next
    monkeypatch.setattr(fingerprints, "with_next", lambda d, c: near(d, c, rows_each=2, most=64))
    rng = random.Random(3)
    ids = [-(2**62), 2**62, 2**63 - 1, -(2**63), 0, *rng.sample(range(10**6), 30), *range(5_000_000, 5_000_020)]
    brute_fingerprints(spark, [(i, f"{prose(n, 30)} {n}") for n, i in enumerate(ids)])
    brute_fingerprints(spark, [(None, f"{prose(n, 30)} é{n}") for n in range(20)])
    brute_fingerprints(spark, [(i % 7 if i % 3 else None, f"{prose(i, 20)} {i}") for i in range(40)])


def resident():
    with open("/proc/self/statm") as f:
        return int(f.read().split()[1]) * 4096 / 1e6


def test_workers_give_their_memory_back():
    def work(batches):
        for batch in batches:
            held = [np.ones(8_000) for _ in range(4_000)]  # each too small for a mapping of its own
            kept.append(held[-1])  # lies above the others
            yield batch

    kept, before = [], resident()
    assert list(common.lean(work)(iter([1]))) == [1] and resident() < before + 100
    before = resident()
    assert common.lean(lambda table: sum(x[0] for x in [np.ones(8_000) for _ in range(4_000)]))(pa.table({})) == 4_000 and resident() < before + 100


def test_near_copies_broadcast_no_table_for_its_small_files(spark, docs, monkeypatch):
    plans, real = {}, common.stored
    monkeypatch.setattr(jaccard_join, "stored", lambda df, kind="table": plans.setdefault(kind, df._jdf.queryExecution().executedPlan().toString()) and real(df, kind))
    few = sorted(map(tuple, jaccard_join.jaccard_join(docs).collect()), key=str)
    assert plans["links"].count("BroadcastHashJoin") == 1  # the documents in units, as they are counted to be few
    plans.clear()
    monkeypatch.setattr(jaccard_join, "_FEW_PLACED", 0, raising=False)
    joined = jaccard_join.jaccard_join(docs)
    plans["end"] = joined._jdf.queryExecution().executedPlan().toString()
    assert {"able", "clusters", "units", "links", "classes"} < set(plans)
    broadcast = {k: plan.count("BroadcastHashJoin") for k, plan in plans.items() if "BroadcastHashJoin" in plan}
    assert broadcast == {"ngrams": 1, "blocks": 1, "units": 1}  # counted ids, and the sums of ranked()
    assert sorted(map(tuple, joined.collect()), key=str) == few


def test_mixing_stage_writes_in_order_without_a_sample_of_the_texts(spark, tmp_path):
    rows = spark.createDataFrame([(i, prose(i, 5), "small" if i < 900 else "big") for i in range(5_000)], "doc_id long, text string, source string")
    mixed = corpus_pipeline.mix_sources(spark, rows, "")
    assert "rangepartitioning" not in mixed._jdf.queryExecution().toString()
    mixed.write.parquet(path := f"file://{tmp_path}/mixed")
    found = spark.read.parquet(path).select("doc_id", F.regexp_extract("_metadata.file_name", r"part-(\d+)", 1).cast("int").alias("file"), "_metadata.row_index").orderBy("file", "row_index").collect()
    assert [r.doc_id for r in found] == [r.doc_id for r in mixing.mix(rows).orderBy("position").collect()] and len({r.file for r in found}) > 1
    assert corpus_pipeline.mix_sources(spark, rows.limit(0), "").count() == 0


def test_mixing_ranks_few_rows_together(spark):
    rows = spark.range(40_000).select(F.col("id").alias("doc_id"), F.lit("one").alias("source"))
    groups = []
    real, common_ranked = mixing.ranked, common.ranked
    mixing.ranked = lambda df, keys, order, ties, buckets, *a: groups.append(df.groupBy(*keys, common.hash_bucket(F.col(order), buckets)).count().agg(F.max("count")).first()[0]) or common_ranked(df, keys, order, ties, buckets, *a)
    try:
        mixing.mix(rows)
    finally:
        mixing.ranked = real
    assert groups[0] < 2_400


def test_mixing_keeps_columns_of_any_name(spark):
    rows = spark.createDataFrame([(i if i % 5 else None, f"s{i % 3}", i * 10, i, "x", i, i) for i in range(60)], "doc_id long, source string, position long, _rank int, _source string, _bucket int, `a.b` int")
    out = mixing.mix(rows, block_rows=4)
    assert out.columns == ["doc_id", "source", "_rank", "_source", "_bucket", "a.b", *mixing.NEW]
    got = out.collect()
    assert sorted(r.position for r in got) == list(range(60)) and sorted(r["a.b"] for r in got) == list(range(60)) == sorted(r["_bucket"] for r in got)


def test_token_files_with_missing_and_repeated_ids(spark):
    rows = [(None, "b"), (-(2**63), "c d"), (None, None), (3, "x"), (3, "x"), (3, "a"), (2**63 - 1, prose(1, 20_000))]
    got = pfor.op4_token_ids(spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, start int")).collect()
    e, at, want = Encoder(default_vocabulary()), 0, []
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = [*e._plain([t or ""])[0], 0]
        want.append((i, at, len(ids), crc32(np.array(ids))))
        at += len(ids)
    assert Counter((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in got) == Counter(want)


def test_warc_ignores_files_of_other_writes(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"http://a/{i}", prose(i, 50)) for i in range(20)], "page_id long, url string, html string")
    warc.write_warc(rows, f"file://{tmp_path}").collect()
    (tmp_path / "part-999999-000000.warc.zst").write_bytes(next(iter(tmp_path.glob("*.zst"))).read_bytes())
    written = spark.createDataFrame([(f.name,) for f in tmp_path.glob("*.zst") if "999999" not in f.name], "file string")
    assert warc.read_warc(spark, f"file://{tmp_path}", written=written).count() == 20


def test_components_with_hubs(spark):
    rng = random.Random(2)
    edges = [(7, i) for i in range(100, 1800)] + [(rng.randrange(100, 3000), rng.randrange(100, 3000)) for _ in range(500)] + [(5000 + i, 5001 + i) for i in range(60)]
    least = {}
    find = lambda x: x if least.setdefault(x, x) == x else find(least[x])
    for a, b in edges:
        a, b = find(a), find(b)
        least[max(a, b)] = min(a, b)
    out = common.components(spark.createDataFrame(edges, "a long, b long")).collect()
    touched = {x for a, b in edges if a != b for x in (a, b)}
    assert {r.node: r.component for r in out} == {x: find(x) for x in touched} and len(out) == len(touched)


def test_packing_against_the_library(spark, docs, texts):
    """Every piece is where the library's ids say, cut as asked, and every id has one place."""
    e = Encoder(default_vocabulary())
    for capacity in (64, 2048):
        got = packing.pack(docs, capacity).collect()
        want = Counter()
        for i, t in texts:
            ids = [*e._plain([t or ""])[0], 0]
            first = len(ids) % capacity or capacity
            bounds = [0, *range(first, len(ids) + 1, capacity)]
            for n, (a, b) in enumerate(zip(bounds, bounds[1:])):
                want[i, n, a, b - a, crc32(np.array(ids[a:b]))] += 1
        assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
        places = {(r.sequence_id, r.offset + k) for r in got for k in range(r.length)}
        assert len(places) == sum(r.length for r in got)


def test_packing_follows_the_order_of_files(spark, tmp_path):
    rows = [(i, " ".join(["word"] * (900 + 40 * (i % 3)))) for i in range(600)]
    random.Random(1).shuffle(rows)
    table = spark.createDataFrame([(n, i, t) for n, (i, t) in enumerate(rows)], "n int, doc_id long, text string")
    table.repartitionByRange(3, "n").sortWithinPartitions("n").drop("n").write.parquet(f"{tmp_path}/in")
    got = corpus_pipeline.pack_sequences(spark, spark.read.parquet(f"{tmp_path}/in"), "").toPandas()
    place = {i: n for n, (i, _) in enumerate(rows)}
    of = got.doc_id.map(place)
    assert len(got) == 600 and np.corrcoef(of, got.sequence_id.rank(method="dense"))[0, 1] > 0.95
    plain = corpus_pipeline.pack_sequences(spark, spark.createDataFrame(rows, DOCS), "")
    assert plain.count() == 600


def test_pipeline_end_to_end(spark, tmp_path):
    """Toxic documents go, one of each group of near copies stays, repeated passages are cut, and every id of the rest has a place."""
    rng = random.Random(12)
    rows = {i: prose(9000 + i, 80) for i in range(240)}
    for i in range(300, 360):  # toxic ones
        words = prose(9000 + i, 60).split()
        for _ in range(4):
            words.insert(rng.randrange(len(words)), rng.choice(["vilefolk", "grumbelos", "grumbelan"]))
        rows[i] = " ".join(words)
    rows[400], rows[401] = rows[3].replace(rows[3].split()[40], "edited", 1), rows[3]
    before, after = prose(9500, 30) + " leading", "ending " + prose(9501, 30)
    rows[402] = f"{before} {' '.join(rows[5].split()[10:70])} {after}"
    rows[403], rows[404] = "", None
    labels = [(i, 1, int(i >= 300)) for i in rows if i < 360 and i % 6]
    spark.createDataFrame([(i, t, "en", f"s{i % 3}", len(t or ""), "x") for i, t in rows.items()], "doc_id long, text string, lang string, source string, n_chars long, position string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    want = {i: t for i, t in rows.items() if i < 300 or i > 401}
    want[402] = f"{before}  {after}"  # words keep the white space before them
    e, got = Encoder(default_vocabulary()), corpus_pipeline.run(spark, f"{tmp_path}").collect()
    pieces = {i: [*e._plain([t or ""])[0], 0] for i, t in want.items()}
    assert {r.doc_id for r in got} == set(want)
    assert {(r.doc_id, r.length, r.ids_crc32) for r in got} == {(i, len(ids), crc32(np.array(ids))) for i, ids in pieces.items()}
    places = [(r.sequence_id, r.offset + k) for r in got for k in range(r.length)]
    assert len(places) == len(set(places)) == sum(map(len, pieces.values()))


@pytest.mark.parametrize("how", ["empty", "null", "repeated"])
def test_operators_on_odd_tables(spark, how):
    """Empty tables, null texts and ids, and repeated rows with clashing columns: every operator gives its rows, none crashes."""
    rows = {"empty": [], "null": [(None, None, None, None)] * 3 + [(1, None, "s", 2)], "repeated": [(7, prose(7, 60), "s", 1)] * 4 + [(7, prose(8, 60), "s", 1), (8, prose(7, 60), None, 1)]}[how]
    docs = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], "doc_id long, text string, source string, n int, _order int, rank int, a int")
    labels = spark.createDataFrame([(r[0], 1, 0) for r in rows], "doc_id long, quality int, toxic int")
    for run in (lambda: quality.op1_quality(docs, labels), lambda: packing.pack(docs), lambda: pfor.op4_token_ids(docs), lambda: mixing.op6_mixing(docs), lambda: fingerprints.op7_fingerprints(docs), lambda: sharding.op8_sharding(docs), lambda: toxicity.op9_toxicity(docs, labels), lambda: jaccard_join.op10_jaccard_join(docs)):
        assert run().count() == len(rows)
    found = passages.op3_passages(docs).collect()
    assert {(r.doc_id, r.partner_id, r.kind) for r in found} == ({(8, 7, "copy")} if how == "repeated" else set())
    assert passages.without_passages(docs, passages.op3_passages(docs)).count() == len(rows) - (how == "repeated")
