"""MinHash near-dedup: banded minima of universal hashes, links confirmed on full sets.

Documents with equal shingle sets are one node from the start. Nodes that share a band are
linked in two steps. First every node tries one centre, the one it shares most bands with:
that joins large groups of near copies with as many comparisons as members. Then all pairs of a
bucket that are in different components still are compared, minority against all, in chunks of
bounded size: their signatures first, and those that pass on their full sets. A pair belongs
to the first band that it shares, so it is decided once. Components come from alternating
large-star and small-star.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema, as_bytes, cut, numbered, pack, set_aside, unpack
from .graph import stars

#: Words of a shingle and least similarity, in per cent, unless a caller says otherwise.
WORDS, PERCENT = 5, 80
#: Minima of a signature; a pair at the least similarity misses every band less often than MISS.
HASHES, MISS = 128, 1e-6
#: A signature passes unless its estimate is this many standard deviations under the level.
DEVIATIONS = 6
SEED = 42
#: Nodes and bytes of sets in a chunk of a crowded bucket.
CHUNK, CHUNK_BYTES = 1024, 16 << 20
#: Words whose hashes a task keeps, and the longest of them.
CACHED, CACHED_BYTES = 1 << 18, 64

_seeded = np.random.default_rng(SEED)
#: The universal hashes: a * x + b modulo 2**32, a odd.
A = _seeded.integers(0, 1 << 32, HASHES, np.uint32) | np.uint32(1)
B = _seeded.integers(0, 1 << 32, HASHES, np.uint32)
#: Odd factors for the words of a shingle, its length and the mixing of bands.
FACTORS = _seeded.integers(0, 1 << 64, 64, np.uint64) | np.uint64(1)
LENGTH, BAND = FACTORS[-1], FACTORS[-2]


class _Words(dict):
    """Hashes of words."""

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh64_intdigest(word, SEED)
        if len(word) <= CACHED_BYTES:
            if len(self) >= CACHED:
                self.clear()
            self[word] = h
        return h


def mixed(x: np.ndarray) -> np.ndarray:
    for shift, factor in ((33, FACTORS[-3]), (29, FACTORS[-4])):
        x = (x ^ (x >> np.uint64(shift))) * factor
    return x ^ (x >> np.uint64(32))


def shingles(text: bytes, words: int, known: _Words) -> np.ndarray:
    """The distinct shingles of a text in order, as 64-bit hashes; the whole sequence if it has
    fewer words."""
    parts = text.lower().split()
    if not parts:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(known.__getitem__, parts), np.uint64, len(parts))
    used, m = min(len(parts), words), max(1, len(parts) - words + 1)
    x = np.full(m, used, np.uint64) * LENGTH
    for j in range(used):
        x += h[j:j + m] * FACTORS[j]
    return np.unique(mixed(x))


def signature(hashes: np.ndarray) -> np.ndarray:
    """The low 16 bits of each hash function's minimum."""
    x, least = hashes.astype(np.uint32), np.full(HASHES, 0xFFFFFFFF, np.uint32)
    for k in range(0, len(x), 512):
        least = np.minimum(least, (A[:, None] * x[k:k + 512] + B[:, None]).min(1))
    return least.astype(np.uint16)


def rows_for(percent: int) -> int:
    """Minima in a band."""
    return next((r for r in (4, 2, 1) if (1 - (percent / 100) ** r) ** (HASHES // r) <= MISS), 1)


def least_equal(percent: int) -> int:
    """Equal minima that a pair needs to be compared on its sets."""
    p = percent / 100
    return int(max(0, HASHES * p - DEVIATIONS * (HASHES * p * (1 - p)) ** 0.5))


SIGNED = "doc_id long, __rid string, n long, set binary, sig binary"


def signed(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, __rid, n, the digest of the shingle set and its signature (null without words)."""
    if not 1 <= words <= len(FACTORS) - 8:
        raise ValueError(f"shingles have 1 to {len(FACTORS) - 8} words")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, schema = _Words(), arrow_schema(SIGNED)
        for b in batches:
            own = [shingles(t, words, known) for t in as_bytes(b.column(2))]
            digests = [xxhash.xxh3_128_digest(x.tobytes(), SEED) if len(x) else None for x in own]
            signatures = [signature(x).tobytes() if len(x) else None for x in own]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(map(len, own), pa.int64()), pa.array(digests, pa.binary()), pa.array(signatures, pa.binary())], schema=schema)

    return docs.select(F.col("doc_id").cast("long"), "__rid", "text").mapInArrow(run, SIGNED)


KEYED = "key long, node long"
#: The low bits of a key are the number of its band.
BAND_BITS = 7


def banded(nodes: DataFrame, rows: int) -> DataFrame:
    """(key, node) for each band of each node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                v = _bands(b.column(1), rows).astype(np.uint64)
                number = np.arange(v.shape[1], dtype=np.uint64)
                keys = mixed(v + number * BAND) << np.uint64(BAND_BITS) | number
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64).ravel()), pa.array(np.repeat(b.column(0).to_numpy(), v.shape[1]))], schema=arrow_schema(KEYED))

    return nodes.select("node", "sig").mapInArrow(run, KEYED)


def _signatures(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u2").reshape(-1, HASHES)


def _bands(column: pa.Array, rows: int) -> np.ndarray:
    return np.ascontiguousarray(_signatures(column)).view({4: "<u8", 2: "<u4", 1: "<u2"}[rows])


SETS = "node long, n long, own binary"


def sets_of(docs: DataFrame, mates: DataFrame, words: int) -> DataFrame:
    """The full sets of the nodes ``mates`` (node, __rid), made from their texts again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, schema = _Words(), arrow_schema(SETS)
        for b in batches:
            own = [shingles(t, words, known) for t in as_bytes(b.column(1))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(map(len, own), pa.int64()), pa.array([x.tobytes() for x in own], pa.binary())], schema=schema)

    return docs.select("__rid", "text").join(mates.select("node", "__rid"), "__rid").select("node", "text").mapInArrow(run, SETS)


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """On sorted distinct hashes."""
    few, many = sorted((len(a), len(b)))
    if 100 * few < percent * many:
        return False
    both = np.sort(np.concatenate([a, b]), kind="stable")  # two runs: merged in one pass
    common = int(np.count_nonzero(both[1:] == both[:-1]))
    return 100 * common >= percent * (len(a) + len(b) - common)


LINKS = "a long, b long"


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of ``pairs`` (a, b) whose sets are similar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            good = [similar(np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8"), percent) for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], schema=arrow_schema(LINKS)).filter(pa.array(good, pa.bool_()))

    side = lambda c: sets.select(F.col("node").alias(c), F.col("own").alias(f"of_{c}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "of_a", "of_b").mapInArrow(run, LINKS)


def centred(rows: DataFrame, turn: int, bands: int) -> DataFrame:
    """(a, b): for every node the centre of another component that it shares most buckets with.
    ``rows`` (key, node, comp); a bucket's centre is a node that a hash of its component picks."""
    by = F.struct(F.xxhash64("comp", F.lit(turn)).alias("h"), "comp", "node")
    middle = rows.groupBy("key").agg(F.min(by).alias("m"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo <> hi").select("key", F.col("m.comp").alias("to"), F.col("m.node").alias("b"))
    shared = rows.join(middle, "key").filter("comp <> to").groupBy("node", "b").count().filter(F.col("count") >= max(1, bands // 4))
    return shared.groupBy("node").agg(F.max_by("b", F.struct("count", "b")).alias("b")).select(F.col("node").alias("a"), "b")


def chunked(rows: DataFrame) -> DataFrame:
    """The buckets that hold several components, dealt out as pairs of chunks: ``rows`` (key,
    node, comp, n, sig) under (key, lo, hi), with the row's own chunk. The nodes of a bucket's
    largest component meet the others only."""
    each = rows.groupBy("key", "comp").agg(F.count("*").alias("c"), F.sum("n").alias("w"))
    per = each.groupBy("key").agg(F.max(F.struct("c", "comp", "w")).alias("top"), F.sum("c").alias("c"), F.sum("w").alias("w")).filter("c > top.c")
    chunks = lambda c, w: F.greatest(F.ceil(c / CHUNK), F.ceil(w * 8 / CHUNK_BYTES), F.lit(1)).cast("int")
    per = per.select("key", F.col("top.comp").alias("major"), chunks(F.col("c") - F.col("top.c"), F.col("w") - F.col("top.w")).alias("ks"), chunks(F.col("top.c"), F.col("top.w")).alias("km"))
    spread = lambda k: F.pmod(F.xxhash64("node"), F.col(k)).cast("int")
    is_major = F.col("comp") == F.col("major")
    dealt = rows.join(per, "key").withColumn("chunk", F.when(is_major, F.col("ks") + spread("km")).otherwise(spread("ks")))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.when(is_major, F.col("ks") - 1).otherwise(F.col("ks") + F.col("km") - 1))))
    return dealt.select("key", F.least("chunk", "other").alias("lo"), F.greatest("chunk", "other").alias("hi"), "chunk", "node", "comp", "n", "sig")


FOUND = "key long, lo int, hi int, nodes array<long>, pairs binary"


def _candidates(group: tuple[int, int, int], t: pa.Table, rows: int, percent: int) -> tuple | None:
    """The pairs of a chunk pair to compare on their sets: (nodes, packed pairs)."""
    key, lo, hi = group
    node, comp, n, chunk = (t.column(c).to_numpy() for c in ("node", "comp", "n", "chunk"))
    column = t.column("sig").combine_chunks()
    sig, bands = _signatures(column), _bands(column, rows)
    band = key & ((1 << BAND_BITS) - 1)
    left, right = np.flatnonzero(chunk == lo), np.flatnonzero(chunk == hi)
    need, found = least_equal(percent), []
    for k in range(0, len(left), 32):
        own = left[k:k + 32]
        may = (comp[own][:, None] != comp[right]) & (100 * np.minimum(n[own][:, None], n[right]) >= percent * np.maximum(n[own][:, None], n[right]))
        if lo == hi:
            may &= own[:, None] < right
        if not may.any():
            continue
        equal = (sig[own][:, None] == sig[right]).sum(2, dtype=np.int16)
        i, j = np.nonzero(may & (equal >= need))
        score = equal[i, j]
        i, j = own[i], right[j]
        first = ~(bands[i][:, :band] == bands[j][:, :band]).any(1)  # else an earlier band has it
        found.append((i[first], j[first], score[first]))
    if not any(len(x[0]) for x in found):
        return None
    i, j, score = (np.concatenate(x) for x in zip(*found, strict=True))
    used, at = np.unique(np.concatenate([i, j]), return_inverse=True)
    order = np.argsort(-score, kind="stable")
    at = at.reshape(2, -1)[:, order].astype("<u4")
    return node[used], pack([comp[used].astype("<i8").tobytes(), at.tobytes()])


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, pa.Table]]:
    """Runs of equal (key, lo, hi) in a sorted stream."""
    held: list[pa.RecordBatch] = []
    now = None
    for b in batches:
        if not b.num_rows:
            continue
        key, lo, hi = (b.column(i).to_numpy() for i in range(3))
        ends = [*(np.flatnonzero((key[1:] != key[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])) + 1).tolist(), b.num_rows]
        start = 0
        for end in ends:
            group = (int(key[start]), int(lo[start]), int(hi[start]))
            if held and group != now:
                yield now, pa.Table.from_batches(held)
                held = []
            now = group
            held.append(b.slice(start, end - start))
            start = end
    if held:
        yield now, pa.Table.from_batches(held)


def screened(rows: DataFrame, minima: int, percent: int) -> DataFrame:
    """For each pair of chunks the nodes and pairs that pass on signatures."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = arrow_schema(FOUND)
        for group, t in _groups(batches):
            if t.num_rows > 1 and (got := _candidates(group, t, minima, percent)):
                yield pa.RecordBatch.from_arrays([*(pa.array([v], f.type) for v, f in zip(group, schema, strict=False)), pa.array([got[0].tolist()], pa.list_(pa.int64())), pa.array([got[1]], pa.binary())], schema=schema)

    return rows.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi").mapInArrow(run, FOUND)


def decided(found: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links among the pairs of ``found``, enough to connect all that are similar: the likeliest
    pairs come first, and one whose ends are connected already is not looked at."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, t in _groups(batches):
            nodes, blob, own = (t.column(c) for c in ("nodes", "pairs", "own"))
            head = next(k for k in range(t.num_rows) if blob[k].is_valid)
            place = {v: k for k, v in enumerate(nodes[head].as_py())}
            full: list = [None] * len(place)
            for k in range(t.num_rows):
                if k != head:
                    full[place[nodes[k][0].as_py()]] = np.frombuffer(own[k].as_py(), "<u8")
            comp, at = unpack(blob[head].as_py())
            names = list(place)
            root: dict[int, int] = {}

            def find(x: int) -> int:
                while root.setdefault(x, x) != x:
                    root[x] = x = root[root[x]]
                return x

            comp, links = np.frombuffer(comp, "<i8").tolist(), []
            for i, j in np.frombuffer(at, "<u4").reshape(2, -1).T.tolist():
                x, y = find(comp[i]), find(comp[j])
                if x != y and similar(full[i], full[j], percent):
                    root[x] = y
                    links.append((names[i], names[j]))
            if links:
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in links], pa.int64()), pa.array([x[1] for x in links], pa.int64())], schema=arrow_schema(LINKS))

    at = ["key", "lo", "hi"]
    none = F.lit(None).cast("binary")
    wanted = found.select(*at, F.explode("nodes").alias("node")).join(sets.select("node", "own"), "node").select(*at, F.array("node").alias("nodes"), none.alias("pairs"), "own")
    mail = wanted.unionByName(found.select(*at, "nodes", "pairs", none.alias("own")))
    return mail.repartition(*at).sortWithinPartitions(*at).mapInArrow(run, LINKS)


def classes(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """(rows, classes) of ``docs`` (doc_id, text, __rid): doc_id, __rid, n, set of every row, and
    set, component_id of every distinct set."""
    minima = rows_for(percent)
    rows = cut(signed(docs, words))
    firsts = rows.filter("set is not null").groupBy("set").agg(F.min("doc_id").alias("first"), F.min("__rid").alias("__rid"), F.first("n").alias("n"), F.first("sig").alias("sig"))
    nodes = cut(firsts.withColumn("node", F.monotonically_increasing_id()))
    keys = banded(nodes, minima)
    shared = cut(keys.join(keys.groupBy("key").count().filter("count > 1").select("key"), "key", "left_semi"))
    mates = cut(nodes.join(shared.select("node").distinct(), "node", "left_semi"))
    known = nodes.select("set", "node", "first")
    if mates.isEmpty():
        return rows, known.select("set", F.col("first").alias("component_id"))
    sets = cut(sets_of(docs, mates, words))
    label = mates.select("node", F.col("node").alias("comp"))
    links = None
    for turn in range(2):
        new = cut(confirmed(centred(shared.join(label, "node"), turn, HASHES // minima), sets, percent))
        if new.isEmpty():
            break
        links = new if links is None else links.union(new)
        label = cut(mates.select("node").join(stars(links), "node", "left").select("node", F.coalesce("root", "node").alias("comp")))
    found = cut(screened(chunked(shared.join(label, "node").join(mates.select("node", "n", "sig"), "node")), minima, percent))
    last = cut(decided(found, sets, percent))
    if not last.isEmpty():
        links = last if links is None else links.union(last)
    if links is not None:
        known = known.join(stars(links), "node", "left").select("set", F.coalesce("root", "node").alias("node"), "first")
    known = cut(known)
    least = known.groupBy("node").agg(F.min("first").alias("component_id"))
    return rows, cut(known.join(least, "node").select("set", "component_id"))


def minhash_report(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of ``docs`` (doc_id, text).

    Documents link if their sets of ``words``-word shingles (the whole sequence of shorter
    texts) have at least ``percent`` of their union in common; sets are compared as 64-bit
    hashes. Null and empty texts and such without words have no shingles, link with nothing and
    are their own component. A component without any doc_id has a null id and keeps nothing;
    rows that repeat a doc_id are kept or not by their own text's component; an empty table
    gives none. A linked pair is missed with a chance below 1e-6.
    """
    own = numbered(docs.select("doc_id", "text"))
    rows, known = classes(own, words, percent)
    out = rows.filter("set is not null").join(known, "set").select("doc_id", "n", "component_id")
    out = out.unionByName(rows.filter("set is null").select("doc_id", "n", F.col("doc_id").alias("component_id")))
    return out.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept"))


def one_of_each(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs``, all columns, that stay: of each component the one with the smallest
    doc_id (null last), of several such rows the first by place; rows without words all stay."""
    docs, given_back = set_aside(docs, "doc_id", "text")
    own = numbered(docs)
    rows, known = classes(own.select("doc_id", "text", "__rid"), words, percent)
    linked = rows.filter("set is not null").join(known, "set")
    best = linked.groupBy("component_id").agg(F.min_by("__rid", F.struct(F.col("doc_id").isNull(), "doc_id", "__rid")).alias("__rid"))
    stay = best.select("__rid").union(rows.filter("set is null").select("__rid"))
    return given_back(own.join(stay, "__rid", "left_semi"))
