"""MinHash components, vector codes and hard negatives against brute force, SQL and odd rows."""

import hashlib
import json

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from .test_text_ops import lower, words


def shingle_set(text, k=3):
    w = words(lower(text or ""))
    return {tuple(w[i:i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def closure(nodes, links):
    """The first node, in the order given, that each node reaches."""
    beside = {x: [] for x in nodes}
    for a, b in links:
        beside[a].append(b), beside[b].append(a)
    root = {}
    for x in nodes:
        todo = [x]
        while todo:
            y = todo.pop()
            if y not in root:
                root[y] = x
                todo += beside[y]
    return root


def brute_components(rows, k=3, percent=85):
    """rows: (doc_id, text). Every pair of different sets is compared; ids of equal sets join."""
    sets = {}
    for i, t in rows:
        sets.setdefault(frozenset(shingle_set(t, k)), []).append(i)
    own = [s for s in sets if s]
    near = [(a, b) for n, a in enumerate(own) for b in own[:n] if 100 * len(a & b) >= percent * len(a | b)]
    root = closure(own, near)
    ids = {}
    for s in own:
        ids.setdefault(root[s], []).extend(i for i in sets[s] if i is not None)
    return {s: min(ids[root[s]], default=None) for s in own}


def held_to_brute_force(report, rows, k=3, percent=85):
    want = brute_components(rows, k, percent)
    expected = []
    for i, t in rows:
        s = frozenset(shingle_set(t, k))
        c = want[s] if s else i
        expected.append((i, len(s), c, i is not None and i == c))
    got = [(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in report.collect()]
    assert sorted(got, key=str) == sorted(expected, key=str)
    return expected


def test_minhash_documents(docs, rows):
    from timbra.llm.minhash import minhash_report

    got = held_to_brute_force(minhash_report(docs, 3, 85), [(i, t) for i, t, _ in rows])
    assert any(not kept for *_, kept in got)
    assert minhash_report(docs.limit(0)).count() == 0
    held_to_brute_force(minhash_report(docs), [(i, t) for i, t, _ in rows], 5, 80)


def test_minhash_group_of_near_copies(spark, monkeypatch):
    """A large group whose copies are linked to each other only in part, with small chunks."""
    from timbra.llm import minhash

    rng = np.random.default_rng(3)
    base = [f"w{x}" for x in rng.integers(0, 5000, 120)]
    texts = []
    for n in range(160):
        t = list(base)
        for at in rng.choice(120, rng.integers(0, 7), replace=False):
            t[at] = f"x{n}"
        texts.append((1000 - n, " ".join(t)))
    texts += [(2000 + n, " ".join(base[:60] + [f"y{n}_{k}" for k in range(60)])) for n in range(40)]
    texts += [(3000, None), (3001, ""), (3002, " \n"), (3003, "a b"), (3004, "A  B"), (3005, "a"), (None, "a b"), (None, base[0]), (3003, "other words of the same id")]
    frame = spark.createDataFrame(texts, "doc_id long, text string")
    held_to_brute_force(minhash.minhash_report(frame, 3, 85), texts)
    monkeypatch.setattr(minhash, "CHUNK", 16)
    held_to_brute_force(minhash.minhash_report(frame, 3, 85), texts)
    # Without the centres the exhaustive comparison alone must find the same.
    monkeypatch.setattr(minhash, "centred", lambda rows, turn, bands: rows.select(F.col("node").alias("a"), F.col("node").alias("b")).limit(0))
    held_to_brute_force(minhash.minhash_report(frame, 3, 85), texts)


def test_minhash_similar_and_bounds():
    from timbra.llm.minhash import least_equal, rows_for, similar

    a = np.arange(100, dtype=np.uint64)
    assert similar(a, a[:85], 85) and not similar(a, a[:84], 85)
    assert similar(a[:93], a[7:], 85) and not similar(a[:92], a[8:], 85)  # 86 and 84 of 100
    assert rows_for(85) == rows_for(80) == 4 and rows_for(50) == 2 and least_equal(100) == 128 and 70 < least_equal(85) < 109


def test_minhash_one_of_each(docs, rows):
    from timbra.llm.minhash import one_of_each

    odd = docs.withColumn("_metadata", F.lit("x")).withColumn("__rid", F.lit(1)).withColumn("node", F.lit(2)).withColumn("set", F.lit(3)).withColumn("n", F.lit(4))
    kept = one_of_each(odd, 3, 85)
    assert kept.columns == odd.columns
    want = brute_components([(i, t) for i, t, _ in rows])
    empty = sum(not shingle_set(t) for _, t, _ in rows)
    assert kept.count() == len(set(want.values())) + empty
    ids = [r.doc_id for r in kept.collect()]
    assert set(ids) >= set(want.values())


def test_stars_are_components(spark):
    from timbra.llm.graph import stars

    rng = np.random.default_rng(5)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(k, k + 1) for k in range(1000, 1040)] + [(5000, k) for k in range(4000, 4100)] + [(7, 7)]
    got = {r.node: r.root for r in stars(spark.createDataFrame(edges, "a long, b long")).collect()}
    nodes = {x for a, b in edges if a != b for x in (a, b)}
    assert got == closure(sorted(nodes), [(a, b) for a, b in edges if a != b])
    assert stars(spark.createDataFrame([], "a long, b long")).count() == 0


# Vectors ----------------------------------------------------------------------------------

ODD = "vec_id long, embedding array<double>, label int"


def odd_vectors(n, width, seed=1, scale=1.0):
    rng = np.random.default_rng(seed)
    rows = [(k, [float(v) for v in rng.normal(0, scale, width)], int(rng.integers(0, 4))) for k in range(n)]
    rows += [(n, None, 1), (n + 1, [None] * width, 1), (n + 2, [float("nan")] * width, 2), (n + 3, [float("inf")] * width, 2), (n + 4, rows[0][1], None), (n + 5, rows[3][1], rows[3][2]), (3, rows[3][1], rows[3][2])]
    return rows


def whole(rows, width):
    out = []
    for i, v, label in rows:
        if v is not None and all(x is not None and np.isfinite(x) for x in v):
            out.append((i, [int(np.floor(256 * x)) for x in v] + [0] * (width - len(v)), label))
    return out


def brute_codes(rows, width, parts=16, entries=64, rounds=2):
    kept = sorted(whole(rows, width), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    w = width // parts
    x = np.array([r[1] for r in kept], object).reshape(len(kept), parts, w)
    books = [[list(v[p]) for v in x[:entries]] for p in range(parts)]

    def nearest(p, v):
        far = [sum((a - b) ** 2 for a, b in zip(v, e, strict=True)) for e in books[p]]
        return min(range(len(far)), key=lambda k: (far[k], k)), min(far)

    for _ in range(rounds):
        for p in range(parts):
            own = {}
            for v in x[:, p]:
                own.setdefault(nearest(p, v)[0], []).append(v)
            for k, members in own.items():
                books[p][k] = [sum(m[c] for m in members) // len(members) for c in range(w)]
    digest = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    out = []
    for (i, _, label), v in zip(kept, x, strict=True):
        got = [nearest(p, v[p]) for p in range(parts)]
        out.append((i, "".join(f"{g[0]:02x}" for g in got), sum(g[1] for g in got), label))
    sums = {}
    for r in out:
        sums[r[3]] = sums.get(r[3], 0) + r[2]
    return sorted(((i, code, error, sums[label], digest) for i, code, error, label in out), key=str)


@pytest.mark.parametrize(("n", "width", "scale"), [(150, 64, 0.2), (20, 32, 3.0), (90, 16, 0.01), (70, 64, 1e9)])
def test_codes_against_brute_force(spark, n, width, scale):
    from timbra.llm.codes import compressed

    rows = odd_vectors(n, width, scale=scale)
    frame = spark.createDataFrame(rows, ODD).withColumn("code", F.lit("x")).withColumn("error", F.lit(1)).withColumn("_metadata", F.lit(1)).withColumn("__rid", F.lit(1))
    got = compressed(frame).collect()
    want = brute_codes(rows, width)
    if scale > 1e6:  # errors beyond a long are null
        assert sorted((r.vec_id, r.code) for r in got) == sorted((w[0], w[1]) for w in want) and got[0].codebooks_sha256 == want[0][4]
        assert all(r.error in (None, *[w[2] for w in want]) for r in got)
    else:
        assert sorted(((r.vec_id, r.code, r.error, r.label_error, r.codebooks_sha256) for r in got), key=str) == want


def test_codes_lengths_and_empty(spark):
    from timbra.llm.codes import compressed

    rows = [(1, [0.5] * 20, 0), (2, [0.25] * 7, 0), (3, [], None), (None, [1.0] * 20, None), (5, [1e306] * 20, 1)]
    got = compressed(spark.createDataFrame(rows, ODD)).collect()
    want = brute_codes(rows[:4], 32)
    assert sorted(((r.vec_id, r.code, r.error, r.label_error, r.codebooks_sha256) for r in got), key=str) == want
    assert compressed(spark.createDataFrame(rows[:0], ODD)).collect() == []
    assert compressed(spark.createDataFrame([(1, None, 1)], ODD)).collect() == []


def test_trees_prune_and_cache(monkeypatch):
    """Far groups are assigned as whole nodes: no distance of single parts is needed."""
    from timbra.llm.codes import LEAF, assign, tree

    rng = np.random.default_rng(2)
    centres = rng.integers(-50_000, 50_000, (2, 8, 4))
    x = np.concatenate([centres[:, [k]] + rng.integers(-20, 20, (2, 500, 4)) for k in range(8)], 1)
    got = assign(tree(x, LEAF), tree(centres, 1), 8)
    want = ((x[:, :, None] - centres[:, None]) ** 2).sum(3).argmin(2)
    assert (got.entry == want).all() and got.pairs < x.shape[0] * x.shape[1] * 8 / 20
    for p in range(2):
        for e in range(8):
            assert (got.sums[p, e] == x[p][want[p] == e].sum(0)).all() and got.counts[p, e] == (want[p] == e).sum()


def brute_negatives(rows, width, every=100, p=5, n=10, share=(30, 90)):
    kept = [(i, tuple(v), label) for i, v, label in whole(rows, width) if label is not None]
    out = []
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True))
    for k, (i, v, label) in enumerate(kept):
        if i is None or i % every:
            continue
        scored = sorted(((-dot(v, c[1]), c[0] is None, c[0] or 0, c[0], c[2]) for m, c in enumerate(kept) if m != k), key=lambda s: s[:3])
        for s in [s for s in scored if s[4] == label][:p]:
            good = [t for t in scored if t[4] != label and share[0] * -s[0] <= -t[0] * 100 <= share[1] * -s[0]][:n]
            out += [(i, s[3], r + 1, t[3], -s[0], -t[0]) for r, t in enumerate(good)]
    return sorted(out, key=str)


@pytest.mark.parametrize(("width", "scale", "block"), [(64, 0.2, 1 << 16), (20, 0.05, 16), (130, 1.0, 64), (64, 1e7, 1 << 16)])
def test_negatives_against_brute_force(spark, monkeypatch, width, scale, block):
    from timbra.llm import negatives

    monkeypatch.setattr(negatives, "ROWS", (block, block))
    monkeypatch.setattr(negatives, "ANCHORS", 7 if block < 1000 else 1 << 13)
    rows = [r if scale < 1e6 else (r[0], r[1] and [x and float(np.round(x)) / 256 if x is not None and np.isfinite(x) else x for x in r[1]], r[2]) for r in odd_vectors(220, width, scale=scale)]
    frame = spark.createDataFrame(rows, ODD).withColumn("rank", F.lit(1)).withColumn("number", F.lit(1)).withColumn("_metadata", F.lit(1)).withColumn("__rid", F.lit(1))
    got = sorted(((r.anchor_id, r.positive_id, r.rank, r.negative_id, r.positive_score, r.negative_score) for r in negatives.hard_negatives(frame, every=10).collect()), key=str)
    assert got == brute_negatives(rows, width, 10) and got
    assert negatives.hard_negatives(frame.limit(0)).collect() == []


def test_intervals_hold_and_prune():
    """Every score lies in its interval after each code, and the intervals narrow."""
    from timbra.llm.negatives import CODES, Planes, encode

    rng = np.random.default_rng(4)
    x = np.floor(256 * rng.normal(0, 0.125, (500, 64)))
    planes, (bits, along, left) = Planes(x[:20]), encode(x)
    widths = []
    for i in range(20):
        near = off = np.zeros(500)
        for k in range(CODES):
            near, off = near + along[k] * planes.along(i, k, bits[k]), off + along[k] * planes.wrong[k][i]
            slack = off + left[k] * planes.length[i] + 1e-6
            assert (np.abs(x @ x[i] - near) <= slack).all()
        widths.append(float(np.median(slack / np.linalg.norm(x, axis=1) / planes.length[i])))
    assert max(widths) < 0.35
    query = x[0]
    near = sum(along[k] * planes.along(0, k, bits[k]) for k in range(CODES))
    slack = sum(along[k] * planes.wrong[k][0] for k in range(CODES)) + left[-1] * planes.length[0]
    kth = np.sort(x @ query)[-6]
    assert (near + slack < kth).mean() > 0.5  # more than half of the rows are never scored


@pytest.mark.parametrize("name", ["op7_line_dedup", "op8_top_k", "op10_suffix_dedup", "op11_minhash", "op12_vector_codes", "op13_hard_negatives"])
def test_sql(spark, name):
    from timbra.llm.queries import QUERIES, SQL

    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    for table in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {table} AS FROM '{sf}/{table}.parquet'")
    frame = QUERIES[name](spark, sf)
    cols = sorted(frame.columns)
    cur = con.execute(SQL[name])
    have = [d[0] for d in cur.description]
    want = sorted(json.dumps([r[have.index(c)] for c in cols]) for r in cur.fetchall())
    assert sorted(json.dumps([r[c] for c in cols]) for r in frame.collect()) == want and want
