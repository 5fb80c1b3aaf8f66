"""BPE encoding and decoding with content-defined chunk reuse.

Texts are cut where a rolling hash of the last bytes says so, hence alike in every document
that holds the same passage, whatever its script. Each distinct chunk of the whole corpus
travels to one task, is encoded there once, and its ids go back to the documents that hold
it. A chunk may end inside a word, so every join is repaired: the stretch around it is
encoded anew, and grows until token ends of both sides agree with its ends.

Only two shuffles move data, as compressed envelopes of a bounded number of text bytes:
chunks to their encoder, ids back. A chunk that a third of all documents share is sent once
for each envelope, so no task sees more than its share.
"""

from __future__ import annotations

import base64
import hashlib
import re
import unicodedata
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema, as_bytes, numbered, pack, shards_for, text_bytes, unpack

ENVELOPE_BYTES = 16 << 20
#: Input bytes whose chunks one task encodes, and the bytes of chunks it remembers.
SHARD_BYTES, MEMORY_BYTES = 64 << 20, 256 << 20
WINDOW, CUT_MASK, SHORTEST, LONGEST = 16, 511, 256, 1 << 14
BASE = 0x9E3779B97F4A7C15 | 1
PIECE = 1 << 20
DIGEST = 16
#: White space beyond so many characters is taken out before the pattern sees it.
LONG_GAP = 1 << 12
GAP = re.compile("[\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]{%d,}" % LONG_GAP)
#: Classes of characters, as the pre-tokenizer's pattern tells them apart.
GAPS, LETTERS, NUMBERS, OTHERS, UNSURE, MARKS = range(6)


@lru_cache(maxsize=1)
def _powers() -> tuple[np.ndarray, np.ndarray]:
    """BASE ** k and BASE ** -k modulo 2 ** 64, for k below PIECE + WINDOW."""
    def run(b: int) -> np.ndarray:
        p = np.full(PIECE + WINDOW, b, np.uint64)
        p[0] = 1
        return np.cumprod(p)

    return run(BASE), run(pow(BASE, -1, 1 << 64))


@lru_cache(maxsize=1)
def _class_table() -> np.ndarray:
    """The class of every code point; UNSURE where Unicode's versions differ. Characters of
    the special token are MARKS: no stretch begins or ends beside them."""
    def kind(c: str) -> int:
        return {"Z": GAPS, "L": LETTERS, "N": NUMBERS, "C": UNSURE}.get(c[0], OTHERS)

    old, new = unicodedata.ucd_3_2_0.category, unicodedata.category
    out = np.full(0x110000, UNSURE, np.uint8)
    for k in [*range(0xD800), *range(0xE000, 0x20000)]:
        c = chr(k)
        one = kind(new(c))
        if kind(old(c)) == one:
            out[k] = one
    out[9:14] = GAPS
    out[[ord(c) for c in "<|>"]] = MARKS
    return out


def _classes(text: bytes) -> np.ndarray:
    """The class of the character that each byte belongs to."""
    raw = np.frombuffer(text, np.uint8)
    table = _class_table()
    if not len(raw) or raw.max() < 128:
        return table[raw]
    out, start = np.empty(len(raw), np.uint8), 0
    while start < len(raw):
        end = min(start + PIECE, len(raw))
        while end < len(raw) and raw[end] & 0xC0 == 0x80:
            end += 1
        points = np.frombuffer(text[start:end].decode().encode("utf-32-le"), "<u4")
        width = 1 + (points > 0x7F).astype(np.int8) + (points > 0x7FF) + (points > 0xFFFF)
        out[start:end] = np.repeat(table[points], width)
        start = end
    return out


def safe_places(text: bytes) -> np.ndarray:
    """Offsets where the pre-tokenizer parts the text whatever stands further away: before
    white space after anything else, and where letters, numbers and other signs meet. White
    space goes with what follows it, and an apostrophe may, so nothing is parted after them."""
    kinds = _classes(text)
    before, after = kinds[:-1], kinds[1:]
    sure = (before != after) & (before != GAPS) & (before < UNSURE) & (after < UNSURE)
    at = np.flatnonzero(sure) + 1
    return at[np.frombuffer(text, np.uint8)[at - 1] != 39] if len(at) else at


def cut_places(text: bytes) -> list[int]:
    """Where the chunks of ``text`` end, the end of the text last; none for an empty text.

    A chunk ends at a character before which WINDOW bytes have a rolling (polynomial) hash
    that is 0 in the CUT_MASK bits, SHORTEST bytes on at least; after LONGEST bytes without
    one it ends at any character."""
    n = len(text)
    if not n:
        return []
    raw = np.frombuffer(text, np.uint8)
    up, down = _powers()
    hits = []
    for start in range(0, n, PIECE):
        first = max(0, start - WINDOW)
        part = raw[first:start + PIECE]
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((part.astype(np.uint64) + np.uint64(1)) * up[:len(part)])])
        h = (sums[WINDOW:-1] - sums[:-1 - WINDOW]) * down[:max(len(part) - WINDOW, 0)]
        at = np.flatnonzero((h >> np.uint64(40)) & np.uint64(CUT_MASK) == 0) + WINDOW
        hits.append(at[part[at] & 0xC0 != 0x80] + first)
    ends, last = [], 0
    for p in [*np.unique(np.concatenate(hits)).tolist(), n]:
        if p - last < SHORTEST and p < n:
            continue
        while p - last > LONGEST:
            last += LONGEST
            while last > 0 and raw[last] & 0xC0 == 0x80:  # not inside a character
                last -= 1
            ends.append(last)
        if p > last:
            ends.append(p)
            last = p
    return ends


class Codec:
    """The byte-level vocabulary at ``path`` (tiktoken ranks), with one special token."""

    def __init__(self, path: str, pattern: str, special: str = "<|endoftext|>"):
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
        self.special = special
        self.bpe = tiktoken.Encoding("corpus", pat_str=pattern, mergeable_ranks=ranks, special_tokens={special: len(ranks)})
        self.kind = np.dtype("<u2" if len(ranks) < 1 << 16 else "<u4")
        pieces = {**{v: k for k, v in ranks.items()}, len(ranks): special.encode()}
        self.pieces = [pieces[k] for k in range(len(pieces))]
        self.lengths = np.array([len(x) for x in self.pieces], np.int64)
        self.ranks = ranks
        self.stretch = lru_cache(maxsize=1 << 16)(self._encode)

    def _encode(self, text: bytes) -> np.ndarray:
        line = text.decode()
        if len(line) < LONG_GAP or not GAP.search(line):
            return np.array(self.bpe.encode(line, allowed_special="all"), self.kind)
        # the pattern's engine has no room for very long white space
        out: list[int] = []
        for k, part in enumerate(line.split(self.special)):
            out += [len(self.ranks)] * (k > 0)
            done = 0
            for m in GAP.finditer(part):
                end = m.end() if m.end() == len(part) else m.end() - 1  # the last one goes with what follows
                out += self.bpe.encode_ordinary(part[done:m.start()])
                out += self._gap(part[m.start():end].encode())
                done = end
            out += self.bpe.encode_ordinary(part[done:])
        return np.array(out, self.kind)

    def _gap(self, text: bytes) -> list[int]:
        """One piece of white space: the merges alone."""
        return self.bpe._encode_single_piece(text)

    def encode(self, text: bytes) -> np.ndarray:
        return self._encode(text) if len(text) > 256 else self.stretch(text)

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.pieces.__getitem__, ids.tolist()))

    def join(self, parts: list[np.ndarray]) -> tuple[np.ndarray, bytes]:
        """(ids, text) of chunks in a row. Every join is repaired: the stretch from the last
        safe place before it to the first one after it is encoded anew; if no token of the
        chunks ends where the stretch begins and ends, it grows by a place on that side."""
        ids = np.concatenate(parts) if parts else np.zeros(0, self.kind)
        text = self.decode(ids)
        if len(parts) < 2:
            return ids, text
        ends = np.concatenate([[0], np.cumsum(self.lengths[ids])])
        edges = ends[np.cumsum([len(p) for p in parts])[:-1]]
        places = np.concatenate([[0], safe_places(text), [len(text)]])
        token = np.searchsorted(ends, places)
        agreed = np.flatnonzero(ends[np.minimum(token, len(ends) - 1)] == places)  # places where a token ends
        places, token = places[agreed], token[agreed]
        low = np.searchsorted(places, edges, side="right") - 1
        high = np.searchsorted(places, edges)
        out, done = [], 0
        for a, b in zip(low.tolist(), high.tolist(), strict=True):
            if a == b or token[b] <= done:  # parted there anyway, or repaired with the join before
                continue
            first = max(int(token[a]), done)
            start = int(ends[first])
            out += [ids[done:first], self.encode(text[start:int(places[b])])]
            done = int(token[b])
        return np.concatenate([*out, ids[done:]]), text


@lru_cache(maxsize=2)
def codec(path: str | None = None, pattern: str | None = None) -> Codec:
    """One for each worker process. Default: the 50k byte-level vocabulary of the machine."""
    import public_tokenizers

    return Codec(path or public_tokenizers.path("byte_bpe_50k.tiktoken"), pattern or public_tokenizers.PATTERN)


#: ``shard`` tells which shard's chunks, or their ids in the same order, a blob holds; DOCS: the documents.
MAIL = "to int, envelope string, shard int, blob binary"
DOCS = -1


def _mail(rows: list[tuple]) -> pa.RecordBatch:
    schema = arrow_schema(MAIL)
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], schema.field(i).type) for i in range(4)], schema=schema)


def _send(shards: int):
    """Documents to envelopes: distinct chunks by shard, and each document's list of chunks,
    numbered through the envelope shard by shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: list[tuple] = []
        size = 0

        def flush() -> pa.RecordBatch:
            place: dict[bytes, tuple[int, int]] = {}
            parts: dict[int, list[bytes]] = {}
            lists, name = [], own[0][2]
            for _, text, _ in own:
                start, refs = 0, []
                for end in cut_places(text):
                    part = text[start:end]
                    at = place.get(part)
                    if at is None:
                        shard = int.from_bytes(_digest(part)[:8], "little") % shards
                        mine = parts.setdefault(shard, [])
                        at = place[part] = (shard, len(mine))
                        mine.append(part)
                    refs.append(at)
                    start = end
                lists.append(refs)
            first, n = {}, 0
            for shard in sorted(parts):
                first[shard], n = n, n + len(parts[shard])
            flat = [np.fromiter((first[s] + j for s, j in refs), "<u4", len(refs)).tobytes() for refs in lists]
            ids = [b"" if r[0] is None else int(r[0]).to_bytes(8, "little", signed=True) for r in own]
            mail = [(zlib.crc32(name.encode()) % shards, name, DOCS, pack(ids + flat, 3))]
            return _mail(mail + [(s, name, s, pack(x, 6)) for s, x in parts.items()])

        for b in batches:
            for row in zip(b.column(0).to_pylist(), as_bytes(b.column(1)), b.column(2).to_pylist(), strict=True):
                if own and size + len(row[1]) > ENVELOPE_BYTES:
                    yield flush()
                    own, size = [], 0
                own.append(row)
                size += len(row[1]) + 64
        if own:
            yield flush()

    return run


def _digest(part: bytes) -> bytes:
    return hashlib.blake2b(part, digest_size=DIGEST).digest()


def _encode(path: str | None, pattern: str | None):
    """In the one task that gets a chunk from everywhere: encode it once, answer every envelope."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        known: dict[bytes, bytes] = {}
        size = 0
        for b in batches:
            for _, envelope, shard, blob in zip(*(x.to_pylist() for x in b.columns), strict=True):
                if shard != DOCS:
                    answers = []
                    for text in unpack(blob):
                        key = _digest(text)
                        ids = known.get(key)
                        if ids is None:
                            ids = known[key] = c.encode(text).tobytes()
                            size += len(ids) + 200
                            while size > MEMORY_BYTES:  # the oldest are encoded again if they return
                                size -= len(known.pop(next(iter(known)))) + 200
                        answers.append(ids)
                    blob = pack(answers, 9)
                yield _mail([(0, envelope, shard, blob)])

    return run


REPORT = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
IDS_OUT = "doc_id long, ids binary"


def _finish(path: str | None, pattern: str | None, digests: bool):
    """Put each envelope's documents together from its ids."""
    schema = arrow_schema(REPORT if digests else IDS_OUT)

    def documents(rows: list[tuple[int, bytes]], c: Codec) -> Iterator[tuple]:
        known, docs = [], []
        for shard, blob in sorted(rows, key=lambda r: r[0]):
            if shard == DOCS:
                docs = list(unpack(blob))
            else:
                known += unpack(blob)
        n = len(docs) // 2
        for key, refs in zip(docs[:n], docs[n:], strict=True):
            doc_id = int.from_bytes(key, "little", signed=True) if key else None
            ids, text = c.join([np.frombuffer(known[k], c.kind) for k in np.frombuffer(refs, "<u4").tolist()])
            wide = ids.astype("<u4").tobytes()
            yield (doc_id, len(ids), hashlib.sha256(wide).hexdigest(), hashlib.sha256(text).hexdigest()) if digests else (doc_id, wide)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        held: list[tuple[int, bytes]] = []
        now = None

        def out() -> Iterator[pa.RecordBatch]:
            rows = list(documents(held, c))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

        for b in batches:
            for envelope, shard, blob in zip(*(b.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
                if now is not None and envelope != now:
                    yield from out()
                    held = []
                now = envelope
                held.append((shard, blob))
        yield from out()

    return run


def encoded(docs: DataFrame, path: str | None = None, pattern: str | None = None, digests: bool = False) -> DataFrame:
    """doc_id and ids (little-endian unsigned 32-bit) of every row of ``docs``; with
    ``digests``: doc_id, n_tokens, ids_sha256 and decoded_sha256 instead.

    The ids are those of the whole text under the vocabulary, special tokens in the text
    included. A null text counts as empty and has no ids; repeated rows give repeated rows;
    an empty table gives none. Other columns are ignored.
    """
    rows = numbered(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    shards = shards_for(docs.sparkSession, text_bytes(rows), SHARD_BYTES)
    rows = rows.select("doc_id", "text", "__rid")
    sent = rows.mapInArrow(_send(shards), MAIL).repartition(shards, "to")
    answers = sent.mapInArrow(_encode(path, pattern), MAIL).repartition(shards, "envelope").sortWithinPartitions("envelope")
    return answers.mapInArrow(_finish(path, pattern, digests), REPORT if digests else IDS_OUT)


def decoded(rows: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id and text of rows (doc_id, ids) as ``encoded`` gives them; null ids: null text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for b in batches:
            texts = [None if x is None else c.decode(np.frombuffer(x, "<u4")).decode() for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return rows.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")
