"""Reversible line dedup: sharded cuckoo filters in front of exact reference counts.

A line's key goes to its shard's filter first. A key that the filter does not know is new: it
is put in and costs nothing more. Only keys that it reports, those held before (or taken for
such), are counted exactly, and only counted keys can lose lines.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from .common import arrow_schema, as_bytes, cut, numbered, set_aside

MIN_CHARS = 10
#: Keys that a shard's filter is made for.
SHARD_KEYS = 1 << 18


def line_key(line: bytes) -> bytes | None:
    """16 bytes that stand for a line's key; None for keys under MIN_CHARS code points.
    ``line`` is lower-cased already; bytes strip exactly [\\x20\\x09-\\x0D]."""
    key = line.strip()
    if len(key) < MIN_CHARS or len(key) < 4 * MIN_CHARS and len(key.decode()) < MIN_CHARS:
        return None
    return hashlib.blake2b(key, digest_size=16).digest()


def keys_of(text: bytes) -> list[bytes | None]:
    return [line_key(x) for x in text.lower().split(b"\n")]


class Cuckoo:
    """A cuckoo filter of 16-bit marks in buckets of four, worked on by whole arrays of keys
    (rows of two uint64). Marks that find no bucket are kept in a list beside them."""

    def __init__(self, n_buckets: int, table: np.ndarray | None = None, rest: np.ndarray | None = None):
        self.n = n_buckets
        self.table = np.zeros((n_buckets, 4), np.uint16) if table is None else table
        self.rest = np.zeros(0, np.int64) if rest is None else rest

    @staticmethod
    def buckets_for(n_keys: int) -> int:
        return 1 << max(2, int(np.ceil(np.log2(max(n_keys, 1) / 4 / 0.8))))

    @classmethod
    def load(cls, raw: bytes) -> Cuckoo:
        n, k = np.frombuffer(raw, np.int64, 2).tolist()
        return cls(n, np.frombuffer(raw, np.uint16, 4 * n, 16).reshape(n, 4).copy(), np.frombuffer(raw, np.int64, k, 16 + 8 * n).copy())

    def dump(self) -> bytes:
        return np.array([self.n, len(self.rest)], np.int64).tobytes() + self.table.tobytes() + self.rest.tobytes()

    def _places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(mark, first bucket, second bucket) of keys."""
        mark = (keys[:, 1] >> np.uint64(48)).astype(np.uint16)
        mark = np.where(mark == 0, np.uint16(1), mark)
        one = (keys[:, 0] & np.uint64(self.n - 1)).astype(np.int64)
        return mark, one, self._other(mark, one)

    def _other(self, mark: np.ndarray, at: np.ndarray) -> np.ndarray:
        return at ^ ((mark.astype(np.int64) * 0x5BD1E995 >> 7) & (self.n - 1))

    @staticmethod
    def _slot(mark: np.ndarray, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        return np.minimum(one, two) << 16 | mark

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """What the filter can tell apart: keys with one slot are known or unknown together."""
        return self._slot(*self._places(keys))

    def contains(self, keys: np.ndarray) -> np.ndarray:
        mark, one, two = self._places(keys)
        found = (self.table[one] == mark[:, None]).any(1) | (self.table[two] == mark[:, None]).any(1)
        return found | np.isin(self._slot(mark, one, two), self.rest) if len(self.rest) else found

    def _put(self, mark: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Put what fits into its bucket; which were put."""
        done = np.zeros(len(mark), bool)
        for slot in range(4):
            todo = np.flatnonzero(~done & (self.table[at, slot] == 0))
            _, first = np.unique(at[todo], return_index=True)
            todo = todo[first]
            self.table[at[todo], slot] = mark[todo]
            done[todo] = True
        return done

    def insert(self, keys: np.ndarray, rounds: int = 500) -> None:
        """Add keys that are not known."""
        mark, at, two = self._places(keys)
        done = self._put(mark, at)
        mark, at = mark[~done], two[~done]
        done = self._put(mark, at)
        mark, at = mark[~done], at[~done]
        rng = np.random.default_rng(len(keys))
        for _ in range(rounds):
            if not len(mark):
                return
            _, first = np.unique(at, return_index=True)  # one kick a bucket and round
            slot = rng.integers(0, 4, len(first))
            out = self.table[at[first], slot].copy()
            self.table[at[first], slot] = mark[first]
            mark, at = mark.copy(), at.copy()
            mark[first] = out
            at[first] = self._other(out, at[first])
            done = (mark == 0) | self._put(mark, at)
            mark, at = mark[~done], at[~done]
        self.rest = np.concatenate([self.rest, self._slot(mark, at, self._other(mark, at))])

    def remove(self, slots: np.ndarray) -> None:
        """Take every mark of these slots out: only where no live key has the slot."""
        mark, one = (slots & 0xFFFF).astype(np.uint16), slots >> 16
        for at in (one, self._other(mark, one)):
            for slot in range(4):
                hit = self.table[at, slot] == mark
                self.table[at[hit], slot] = 0
        self.rest = self.rest[~np.isin(self.rest, slots)]


def _as_words(keys: pd.Series | list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(keys), np.uint64).reshape(-1, 2)


def _shard(n: int):
    """A key's shard, from bits that neither the mark nor the bucket uses first."""
    return F.pmod(F.xxhash64("key"), F.lit(n)).cast("long")


POSTINGS = "key binary, doc_id long, rid string"


def postings(rows: DataFrame) -> DataFrame:
    """(key, doc_id, rid) once for each distinct key of each numbered document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, at = [], []
            for i, text in enumerate(as_bytes(b.column(1))):
                own = dict.fromkeys(keys_of(text))
                own.pop(None, None)
                keys += own
                at += [i] * len(own)
            take = pa.array(at, pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), b.column(0).take(take), b.column(2).take(take)], schema=arrow_schema(POSTINGS))

    return rows.select("doc_id", "text", "__rid").mapInArrow(run, POSTINGS)


REFS = "key binary, refs long, first_doc long, last_doc long"
FILTERS = "shard long, blob binary"
#: What a shard's task reads and gives: its stored filter first, then keys.
STREAM = "shard long, kind int, times long, key binary"
FILTER, KEY = 0, 1


def combined(posted: DataFrame) -> DataFrame:
    """(times, key): keys of a task once for each of its windows, so that a line of all
    documents does not crowd one shard."""
    schema = "times long, key binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[bytes] = Counter()

        def full() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(seen.values()), pa.int64()), pa.array(list(seen), pa.binary())], schema=arrow_schema(schema))

        for b in batches:
            seen.update(b.column(0).to_pylist())
            if len(seen) > 1 << 19:
                yield full()
                seen.clear()
        yield full()

    return posted.select("key").mapInArrow(run, schema)


def stream(buckets: int):
    """Run the keys of shard after shard through its filter: those that it knows, or that come
    twice at once, are reported; the others are put in. The filters come out at the end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = arrow_schema(STREAM)
        now, f, told = None, None, set()

        def rows(kind: int, blobs: list[bytes]) -> pa.RecordBatch:
            n = len(blobs)
            return pa.RecordBatch.from_arrays([pa.array([now] * n, pa.int64()), pa.array([kind] * n, pa.int32()), pa.array([1] * n, pa.int64()), pa.array(blobs, pa.binary())], schema=schema)

        for b in batches:
            shards, kinds, times = (b.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            starts = np.flatnonzero(np.concatenate([[True], (shards[1:] != shards[:-1]) | (kinds[1:] != kinds[:-1])])) if len(shards) else []
            for x, y in zip(starts, [*starts[1:], len(shards)], strict=True):
                if shards[x] != now:
                    if f is not None:
                        yield rows(FILTER, [f.dump()])
                    now, f, told = int(shards[x]), Cuckoo(buckets), set()
                blobs = b.column(3).slice(x, y - x).to_pylist()
                if kinds[x] == FILTER:
                    f = Cuckoo.load(blobs[0])
                    continue
                first: dict[bytes, int] = {}
                for key, n in zip(blobs, times[x:y].tolist(), strict=True):
                    first[key] = first.get(key, 0) + n
                own = list(first)
                words = _as_words(own)
                known = f.contains(words)
                f.insert(_one_each(f, words[~known]))
                new = [k for k, old, n in zip(own, known.tolist(), first.values(), strict=True) if (old or n > 1) and k not in told]
                told.update(new)
                if new:
                    yield rows(KEY, new)
        if f is not None:
            yield rows(FILTER, [f.dump()])

    return run


def _one_each(f: Cuckoo, words: np.ndarray) -> np.ndarray:
    """One key of each slot."""
    return words[np.unique(f.slots(words), return_index=True)[1]]


@dataclass
class LineIndex:
    """Which lines the inserted documents hold.

    ``posted`` (key, doc_id, rid) is exact and grows by what is inserted. ``filters`` (shard,
    blob) know every key in it. ``refs`` (key, refs, first_doc, last_doc) has exact counts of
    the keys that a filter has reported; a key without one has one holder. Insert and delete
    return a new index of written tables. Documents with a null id take no part. A shard is
    worked on in one task and holds about SHARD_KEYS keys, so the number of shards follows
    the number of keys.
    """

    posted: DataFrame
    refs: DataFrame
    filters: DataFrame
    shards: int = 0
    buckets: int = 0
    #: Postings in the index, and so many as its filters are made for.
    size: int = 0
    room: int = 0

    @classmethod
    def empty(cls, spark: SparkSession) -> LineIndex:
        return cls(spark.createDataFrame([], POSTINGS), spark.createDataFrame([], REFS), spark.createDataFrame([], FILTERS))

    @staticmethod
    def _counted(posted: DataFrame) -> DataFrame:
        return posted.groupBy("key").agg(F.count("*").alias("refs"), F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc"))

    def probe(self, keys: DataFrame) -> DataFrame:
        """``keys`` (key, ...) with ``maybe``: false means that no live document holds the line."""
        if not self.shards:
            return keys.withColumn("maybe", F.lit(False))
        schema = StructType([*keys.schema, StructField("maybe", BooleanType())])

        def look(own: pd.DataFrame, stored: pd.DataFrame) -> pd.DataFrame:
            known = Cuckoo.load(stored["blob"].iloc[0]).contains(_as_words(own["key"])) if len(stored) and len(own) else np.zeros(len(own), bool)
            return own.drop(columns="shard").assign(maybe=known)

        return keys.withColumn("shard", _shard(self.shards)).groupBy("shard").cogroup(self.filters.groupBy("shard")).applyInPandas(look, schema)

    def insert(self, docs: DataFrame) -> LineIndex:
        """Add documents. Their keys pass the filters; those that these report are counted
        anew over the postings, all others are new and held once. Filters are made anew, for
        twice the postings, when those outgrow them."""
        new = cut(postings(numbered(docs).filter("doc_id is not null")))
        size = self.size + new.count()
        posted, fits = self.posted.unionByName(new) if self.size else new, size <= self.room
        shards, room = (self.shards, self.room) if fits else (max(1, -(-size // SHARD_KEYS)), max(2 * size, 1024))
        buckets = self.buckets if fits else Cuckoo.buckets_for(room // shards)
        keys = combined(new if fits else posted).select(_shard(shards).alias("shard"), F.lit(KEY).alias("kind"), "times", "key")
        stored = self.filters.select("shard", F.lit(FILTER).alias("kind"), F.lit(1).cast("long").alias("times"), F.col("blob").alias("key"))
        rows = (keys.unionByName(stored) if fits else keys).repartition("shard").sortWithinPartitions("shard", "kind")
        out = cut(rows.mapInArrow(stream(buckets), STREAM))
        told = out.filter(F.col("kind") == KEY).select("key")
        # written before it is counted, so that Spark can split a line of all documents in the join
        counted = self._counted(cut(posted.join(told, "key", "left_semi").select("key", "doc_id")))
        refs = cut(self.refs.join(told, "key", "left_anti").unionByName(counted) if self.size else counted)
        return LineIndex(posted, refs, out.filter(F.col("kind") == FILTER).select("shard", F.col("key").alias("blob")), shards, buckets, size, room)

    def _slots(self, keys: DataFrame) -> DataFrame:
        """(key, shard, slot) of keys."""
        f = Cuckoo(self.buckets, np.zeros((0, 4), np.uint16))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(f.slots(_as_words(b.column(0).to_pylist())), pa.int64())], names=["key", "shard", "slot"])

        return keys.select("key", _shard(self.shards).alias("shard")).mapInArrow(run, "key binary, shard long, slot long")

    def delete(self, doc_ids: DataFrame) -> LineIndex:
        """Take documents out: only the keys that they held are counted anew. The marks of keys
        that nobody holds any more leave the filters, unless a live key shares them."""
        if not self.shards:
            return self
        ids = doc_ids.select(doc_ids["doc_id"].alias("doc_id")).distinct()
        gone = cut(self.posted.join(ids, "doc_id", "left_semi").select("key").distinct())
        posted = cut(self.posted.join(ids, "doc_id", "left_anti").select("key", "doc_id", "rid"))
        recount = cut(self._counted(posted.join(gone, "key", "left_semi")))
        refs = cut(self.refs.join(gone, "key", "left_anti").unionByName(recount.join(self.refs.select("key"), "key", "left_semi")))
        dead = cut(self._slots(gone.join(recount, "key", "left_anti")).select("shard", "slot").distinct())
        live = self._slots(posted).join(dead, ["shard", "slot"], "left_semi").select("shard", "slot").distinct()

        def drop(own: pd.DataFrame, stored: pd.DataFrame) -> pd.DataFrame:
            if len(own) and len(stored):
                f = Cuckoo.load(stored["blob"].iloc[0])
                f.remove(own["slot"].to_numpy(np.int64))
                stored = stored.assign(blob=[f.dump()])
            return stored

        free = dead.join(live, ["shard", "slot"], "left_anti")
        filters = cut(free.groupBy("shard").cogroup(self.filters.groupBy("shard")).applyInPandas(drop, FILTERS))
        return LineIndex(posted, refs, filters, self.shards, self.buckets, posted.count(), self.room)

    def dropped(self) -> DataFrame:
        """(rid, keys): what each inserted document loses: its lines of keys that a document
        with a smaller id holds. Lines of one document only never leave the first join."""
        shared = cut(self.refs.filter("first_doc < last_doc").select("key", "first_doc"))
        rows = self.posted.join(shared, "key").filter("doc_id > first_doc")
        return rows.groupBy("rid").agg(F.collect_list("key").alias("keys"))


def _kept(text: bytes, keys: list[bytes] | None) -> tuple[list[bytes], int]:
    lines = text.split(b"\n")
    if not keys:
        return lines, len(lines)
    gone = set(keys)
    return [x for x in lines if line_key(x.lower()) not in gone], len(lines)


def _with_drops(docs: DataFrame) -> DataFrame:
    drops = LineIndex.empty(docs.sparkSession).insert(docs).dropped()
    return numbered(docs).join(drops.select(F.col("rid").alias("__rid"), F.col("keys").alias("__keys")), "__rid", "left")


DIGEST = "doc_id long, n_lines long, n_dropped long, kept_sha256 string"


def dedup_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_dropped and kept_sha256 for every row of ``docs``, a stored table.

    A null or empty text is one empty line. Rows with a null id keep all lines and count for
    nobody. Rows that repeat a doc_id are one document: its lines stay in each of them.
    """
    marked = _with_drops(docs.select("doc_id", "text")).select("doc_id", "text", "__keys")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, out, sha = [], [], []
            for text, keys in zip(as_bytes(b.column(1)), b.column(2).to_pylist(), strict=True):
                kept, lines = _kept(text, keys)
                n.append(lines)
                out.append(lines - len(kept))
                sha.append(hashlib.sha256(b"\n".join(kept)).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(out, pa.int64()), pa.array(sha, pa.string())], schema=arrow_schema(DIGEST))

    return marked.mapInArrow(run, DIGEST)


def deduped(docs: DataFrame) -> DataFrame:
    """``docs`` with the lines gone from ``text``; a null text stays null; all columns stay,
    whatever they are called."""
    @F.pandas_udf("string")
    def clean(texts: pd.Series, keys: pd.Series) -> pd.Series:
        return pd.Series([t if t is None or k is None else b"\n".join(_kept(t.encode(), list(k))[0]).decode() for t, k in zip(texts, keys, strict=True)], dtype=object)

    own, given_back = set_aside(docs, "doc_id", "text")
    return given_back(_with_drops(own).withColumn("text", clean(F.col("text"), F.col("__keys"))))
