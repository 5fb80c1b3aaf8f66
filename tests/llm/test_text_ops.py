"""Quality rules, mixing, line dedup and SimHash against brute force."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

WS = " \t\n\x0b\x0c\r"


def words(text):
    for c in WS:
        text = text.replace(c, " ")
    return [w for w in text.split(" ") if w]


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def test_quality_counts(spark, sf, docs, rows):
    from timbra.llm.quality import quality_filter, quality_report

    labels = spark.read.parquet(f"{sf}/labels.parquet")
    got = quality_report(docs, labels).collect()
    want = []
    for i, text, _ in rows:
        text = text or ""
        w = words(text)
        grams = [tuple(w[k:k + 5]) for k in range(len(w) - 4)]
        n = Counter(grams)
        hit = {k + j for k, g in enumerate(grams) if n[g] > 1 for j in range(5)}
        lines = [x for x in text.split("\n") if words(x)]
        want.append((i, len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit), len(w) < 10 or 100 * len(hit) > 20 * len(w)))
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted([(r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got], key=key) == sorted(want, key=key)
    assert not any(r.kept and r.base_failed for r in got)
    kept = quality_filter(docs, labels)
    assert kept.columns == docs.columns and kept.count() == sum(r.kept for r in got)


def test_quality_separates(spark):
    from timbra.llm.quality import quality_report

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    got = {r.doc_id: r for r in quality_report(docs, labels).collect()}
    marks = [(got[r.doc_id], r.quality) for r in labels.collect() if r.doc_id in got]
    good = [r.kept for r, q in marks if q == 1 and not r.base_failed]
    bad = [r.kept for r, q in marks if q == 0]
    assert np.mean(good) > 0.99 and np.mean(bad) < 0.35


def test_quality_without_labels(spark, docs):
    from pyspark.sql import functions as F

    from timbra.llm.quality import quality_report

    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert all(r.kept != r.base_failed for r in quality_report(docs, none).collect())
    for q in (0, 1):  # one kind of label alone calibrates nothing
        one = docs.filter("doc_id < 100").select("doc_id", F.lit(q).alias("quality"), F.lit(0).alias("toxic"))
        assert all(r.kept != r.base_failed for r in quality_report(docs, one).collect())
    assert quality_report(docs.limit(0), none).count() == 0


def test_forest_path_lengths():
    from timbra.llm.quality import Forest

    rng = np.random.default_rng(0)
    near, far = rng.normal(0, 1, (500, 3)), rng.normal(9, 0.1, (5, 3))
    s = Forest(np.vstack([near, far]), n_trees=50, psi=128).score(np.vstack([near, far]))
    assert s[-5:].min() > np.quantile(s[:500], 0.95)
    assert len(Forest(np.zeros((0, 3))).score(near)) == 500


def fill(sizes, weights, epochs):
    total, fixed = sum(sizes.values()), {}
    while True:
        free = [s for s in sizes if s not in fixed]
        rest, w = total - sum(fixed.values()), sum(weights[s] for s in free)
        over = [s for s in free if weights[s] * rest / w > epochs * sizes[s]] if w else []
        if not over:
            return fixed | {s: weights[s] * rest / w for s in free}
        fixed |= {s: epochs * sizes[s] for s in over}


def test_mixing(docs, rows):
    from timbra.llm.mixing import mix_report, mixed

    sizes = defaultdict(int)
    for _, text, s in rows:
        sizes[s] += len(words(text or ""))
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    target = fill(sizes, {s: 1 + k % 3 for k, s in enumerate(order)}, 3)
    got = mix_report(docs).collect()
    assert len(got) == len(rows) and sorted(got, key=str) == sorted(mix_report(docs).collect(), key=str)
    by_id = {(i, len(words(t or ""))): s for i, t, s in rows}
    taken, largest = Counter(), Counter()
    for r in got:
        s = by_id[r.doc_id, r.size]
        assert r.source_size == sizes[s] and r.target == pytest.approx(target[s]) and r.taken <= 3 * r.size
        assert r.size == 0 or r.taken % r.size == 0
        taken[s] += r.taken
        largest[s] = max(largest[s], r.size)
    for s in sizes:
        assert abs(taken[s] - target[s]) <= largest[s] / 2 + 1
    out = mixed(docs)
    assert out.columns == docs.columns and out.count() == sum(r.taken // r.size for r in got if r.size)
    assert mix_report(docs.limit(0)).count() == 0


def dedup(rows):
    own = [[lower(x).strip(WS) for x in (t or "").split("\n")] for _, t, _ in rows]
    holds = defaultdict(set)
    for (i, _, _), keys in zip(rows, own, strict=True):
        for k in keys:
            if len(k) >= 10 and i is not None:
                holds[k].add(i)
    out = []
    for (i, t, _), keys in zip(rows, own, strict=True):
        lines = (t or "").split("\n")
        kept = [x for x, k in zip(lines, keys, strict=True) if i is None or len(holds.get(k, ())) < 2 or min(holds[k]) == i]
        out.append((i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


def test_line_dedup(docs, rows):
    from timbra.llm.linededup import dedup_report, deduped

    got = sorted(map(tuple, dedup_report(docs).collect()), key=str)
    assert got == dedup(rows) and any(r[2] for r in got)
    out = deduped(docs)
    assert out.columns == docs.columns
    assert Counter(hashlib.sha256((r.text or "").encode()).hexdigest() for r in out.collect()) == Counter(r[3] for r in got)
    assert dedup_report(docs.limit(0)).count() == 0


def test_line_index_is_reversible(spark, docs):
    from pyspark.sql import functions as F

    from timbra.llm.linededup import LineIndex

    known = docs.filter("doc_id is not null").dropDuplicates(["doc_id"])
    first, second = known.filter("doc_id % 3 <> 0"), known.filter("doc_id % 3 = 0")
    state = lambda x: (sorted((bytes(r.key), r.refs, r.first_doc, r.last_doc) for r in x.refs.filter("refs > 1").collect()), sorted((bytes(r.key), r.doc_id) for r in x.posted.collect()))
    a = LineIndex.empty(spark).insert(first)
    both = a.insert(second)
    assert state(both) == state(LineIndex.empty(spark).insert(known))
    grown = LineIndex.empty(spark).insert(known.filter("doc_id < 3")).insert(known.filter("doc_id >= 3"))
    assert grown.room > 1024 and state(grown) == state(both)  # filters made anew on the way
    back = both.delete(second.select("doc_id"))
    assert state(back) == state(a)
    keys = a.posted.select("key").distinct()
    assert back.probe(keys).agg(F.min("maybe")).first()[0] is True and both.probe(keys).agg(F.min("maybe")).first()[0] is True
    gone = both.posted.join(a.posted, "key", "left_anti").select("key").distinct()
    assert gone.count() > 100 and back.probe(gone).filter("maybe").count() <= 0.01 * gone.count() + 2
    assert state(back.insert(second)) == state(both) and state(back.delete(first.select("doc_id")))[1] == []


def test_line_dedup_needs_the_filters(spark, docs, monkeypatch):
    """What the filters do not report loses no line; what they report wrongly is counted."""
    import pyarrow as pa

    from timbra.llm import linededup
    from timbra.llm.linededup import FILTER, KEY, STREAM, Cuckoo, dedup_report, stream

    keys = [hashlib.blake2b(bytes([k]), digest_size=16).digest() for k in range(200)]
    rows = [(7, KEY, 1, k) for k in [*keys, *keys[:50]]] + [(9, KEY, 2, keys[0]), (9, KEY, 1, keys[1])]
    batch = lambda x: pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*x, strict=True)], schema=pa.schema([("shard", pa.int64()), ("kind", pa.int32()), ("times", pa.int64()), ("key", pa.binary())]))
    go = lambda x, n=40: [tuple(r.values()) for b in stream(64)(iter([batch(x[k:k + n]) for k in range(0, len(x), n)])) for r in b.to_pylist()]
    out = go(rows)
    assert {r[3] for r in out if r[:2] == (7, KEY)} == set(keys[:50]) and [r[3] for r in out if r[:2] == (9, KEY)] == [keys[0]]
    stored = [r for r in out if r[:2] == (7, FILTER)]
    again = go([(7, FILTER, 1, stored[0][3]), (7, KEY, 1, keys[60]), (7, KEY, 1, b"0123456789abcdef")])
    assert [r[3] for r in again if r[1] == KEY] == [keys[60]]
    monkeypatch.setattr(Cuckoo, "contains", lambda self, k: np.zeros(len(k), bool))
    assert not [r for r in go(rows) if r[:2] == (7, KEY) and r[3] in keys[:10]]
    assert STREAM.count(",") == 3
    silent = lambda buckets: lambda batches: (b.filter(pa.compute.equal(b.column(1), FILTER)) for b in linededup_stream(buckets)(batches))
    linededup_stream = linededup.stream
    import pyarrow.compute  # noqa: F401

    monkeypatch.setattr(linededup, "stream", silent)
    assert not any(r.n_dropped for r in dedup_report(docs).collect())


def test_cuckoo_filter():
    from timbra.llm.linededup import Cuckoo

    rng = np.random.default_rng(1)
    keys = rng.integers(0, 1 << 63, (20000, 2)).astype(np.uint64) * np.uint64(2)
    for size in (10000, 4000):  # roomy, and too small: the rest is listed
        f = Cuckoo(Cuckoo.buckets_for(size))
        f.insert(keys[:5000]), f.insert(keys[5000:10000])
        assert f.contains(keys[:10000]).all() and f.contains(keys[10000:]).mean() < 0.02 and (len(f.rest) > 0) == (size == 4000)
        f = Cuckoo.load(f.dump())
        live = set(f.slots(keys[5000:10000]).tolist())
        f.remove(np.array([s for s in f.slots(keys[:5000]).tolist() if s not in live]))
        assert f.contains(keys[5000:10000]).all() and f.contains(keys[:5000]).mean() < 0.02


def test_clashing_names(spark, tmp_path):
    """Columns named like an operator's own come back as they were."""
    from timbra.llm.linededup import deduped
    from timbra.llm.mixing import mixed
    from timbra.llm.quality import quality_filter
    from timbra.llm.simhash import one_of_each

    names = ["__rid", "__text", "_metadata", "__keys", "__size", "__skey", "__n", "__batch", "rid", "fp", "score", "shard", "kind"]
    rows = [(k, f"a line that all hold\nnumber {k} " + " ".join(f"w{k}x{j}" for j in range(30)), "s", *[f"{n}{k}" for n in names]) for k in range(6)]
    path = str(tmp_path / "odd.parquet")
    spark.createDataFrame(rows, ["doc_id", "text", "source", *names]).write.parquet(path)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for docs in (spark.read.parquet(path), spark.createDataFrame(rows, ["doc_id", "text", "source", *names])):
        for f in (deduped, one_of_each, mixed, lambda d: quality_filter(d, labels)):
            out = f(docs)
            assert out.columns == docs.columns
            got = out.dropDuplicates(["doc_id"]).collect()
            assert got and all([r[n] for n in names] == [f"{n}{r.doc_id}" for n in names] for r in got)
        assert sorted(r.text.count("all hold") for r in deduped(docs).collect()) == [0] * 5 + [1]


def fp(text):
    w = words(lower(text or ""))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[k:k + 3]).encode(), 42) for k in range(max(1, len(w) - 2))]
    return sum((2 * sum(x >> b & 1 for x in h) > len(h)) << b for b in range(64))


def closure(fps):
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(fps)):
        for b in range(a):
            if (fps[a] ^ fps[b]).bit_count() <= 3:
                root[max(find(a), find(b))] = min(find(a), find(b))
    return [find(x) for x in range(len(fps))]


def test_simhash(docs, rows):
    from timbra.llm.simhash import one_of_each, simhash_report

    fps = [fp(t) for _, t, _ in rows]
    root = closure(fps)
    least = {}
    for r, (i, _, _) in zip(root, rows, strict=True):
        least[r] = min((x for x in (least.get(r), i) if x is not None), default=None)
    want = sorted(((i, f"{f:016x}", least[r]) for (i, _, _), f, r in zip(rows, fps, root, strict=True)), key=str)
    assert sorted(map(tuple, simhash_report(docs).collect()), key=str) == want
    kept = one_of_each(docs)
    assert kept.columns == docs.columns and kept.count() == len(set(root))
    assert simhash_report(docs.limit(0)).count() == 0


def test_crowded_buckets(spark, monkeypatch):
    """Buckets beyond the bound are cut again and lose no link."""
    from timbra.llm import simhash

    rng = np.random.default_rng(5)
    base = [int(x) for x in rng.integers(0, 1 << 63, 4)]
    fps = sorted({b ^ sum(1 << int(k) for k in rng.integers(0, 64, rng.integers(0, 6))) for b in base for _ in range(60)})
    fps = [x - (1 << 64) if x >> 63 else x for x in fps]
    monkeypatch.setattr(simhash, "BUCKET", 4)
    got = simhash.classes(spark.createDataFrame([(k, x) for k, x in enumerate(fps)], "doc_id long, fp long"))
    assert {r.fp: r.component_id for r in got.collect()} == dict(zip(fps, closure([x % (1 << 64) for x in fps]), strict=True))


def test_components(spark):
    from timbra.llm.graph import components

    chain = [(k, k + 1) for k in range(40)] + [(100, 100), (200, 300), (7, 7)]
    got = {r.node: r.root for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**{k: 0 for k in range(41)}, 200: 200, 300: 200}
