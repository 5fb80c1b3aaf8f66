"""Language-model scoring with Brown classes: exchange clustering, class bigrams, word emissions.

Every word of the training texts has a class that its neighbours chose. The most frequent
words (HEAD of them, held by every task) are exchanged between classes over the table of
their word bigrams, which stays in Spark: each round is one scan of it, in which every word
finds the class that raises the likelihood most, and one scan that measures what the moves
gave. All other words then join the class of highest likelihood by the classes beside them;
their counts, profiles and classes travel as mail between the documents and the words.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema, as_bytes, cut, numbered, pack, shards_for, text_bytes, unpack

#: Words that every task holds, and the longest such word in bytes: a bound of HEAD * HEAD_BYTES
#: for what is sent to a task. No word is left out: others get their classes by mail.
HEAD, HEAD_BYTES = (1 << 16) - 2, 64
CLASSES = 64
#: Symbols beside the head's words: a text's end, and any other word; classes beside the
#: words': a text's end, words that have none yet.
END, REST = HEAD, HEAD + 1
ENDS, NONE = CLASSES, CLASSES + 1
SIDE = CLASSES + 2
UNSEEN = 255
#: The first words are classes of their own; words are then inserted in batches, each so many
#: times larger than all before.
GROWTH = 4
#: Exchange ends when a round raises the likelihood by less than this share of it.
TOLERANCE = 1e-4
#: Pseudo-counts of the class unigram behind each class bigram.
PRIOR = 20.0
#: Text bytes in an envelope and for each partition of the tables; pairs counted at once.
ENVELOPE_BYTES, SHARD_BYTES, FLUSH = 16 << 20, 32 << 20, 1 << 22


def held_out(doc_id):
    """Documents kept from training; a null id trains."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 7 == 2, F.lit(False))


COUNTED = "word binary, n long"


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n) over the whole texts of ``docs``: each task counts first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[bytes] = Counter()

        def full() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], schema=arrow_schema(COUNTED))

        for b in batches:
            for text in as_bytes(b.column(0)):
                counts.update(text.lower().split())
                if len(counts) > 1 << 19:
                    yield full()
                    counts.clear()
        yield full()

    return docs.select("text").mapInArrow(run, COUNTED).groupBy("word").agg(F.sum("n").alias("n"))


@dataclass
class Head:
    """The most frequent words, most frequent first, and their counts."""

    words: dict[bytes, int]
    n: np.ndarray

    def look(self, words: list[bytes]) -> np.ndarray:
        get = self.words.get
        return np.fromiter((get(w, REST) for w in words), np.uint16, len(words))


def head_of(counts: DataFrame) -> Head:
    """At most HEAD words. Sums over logarithmic ranges of n first tell how many can matter."""
    short = counts.filter(F.octet_length("word") <= HEAD_BYTES)
    level = F.floor(F.log2("n") * 8).cast("int")
    sizes = sorted(((r[0], r[1]) for r in short.groupBy(level.alias("level")).count().collect()), reverse=True)
    total, least = 0, 0
    for value, n in sizes:
        total, least = total + n, value
        if total >= HEAD:
            break
    rows = short.filter(level >= least).orderBy(F.col("n").desc(), "word").limit(HEAD).select("word", "n").collect()
    return Head({bytes(r[0]): k for k, r in enumerate(rows)}, np.array([r[1] for r in rows], np.int64))


# Word bigrams of the head ------------------------------------------------------------------

PAIRS = "shard int, blob binary"


def _planes(x: np.ndarray) -> bytes:
    """Numbers by byte position: the high ones are mostly equal and pack well."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes()


def _from_planes(raw: bytes, kind: str) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(width, -1).T).view(kind).ravel()


def _summed(codes: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes in order and the sums of their ``n``."""
    order = np.argsort(codes, kind="stable")
    codes, n = codes[order], n[order]
    starts = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]])) if len(codes) else np.zeros(0, np.int64)
    return codes[starts], np.add.reduceat(n, starts) if len(starts) else n


def neighbours(docs: DataFrame, head: Head, shards: int) -> DataFrame:
    """The head's word bigrams, by the word (for a block of words: what follows each and how
    often, what precedes it and how often). A written table. A word has at most 2 * (HEAD + 2)
    entries; ends and other words are listed as words with one another only."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def full() -> Iterator[pa.RecordBatch]:
            s = np.concatenate(held).astype(np.uint64)
            a, b = s[:-1], s[1:]
            both, ones = (a << np.uint64(16) | b), a < HEAD
            sides = both[ones | (b >= HEAD)], (b << np.uint64(16) | a)[b < HEAD]
            rows = []
            for side, codes in enumerate(sides):
                codes, n = np.unique(((codes >> np.uint64(16)) % np.uint64(shards)) << np.uint64(32) | codes, return_counts=True)
                shard = (codes >> np.uint64(32)).astype(np.int64)
                bounds = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1], [True]])) if len(shard) else np.zeros(1, np.int64)
                for x, y in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                    own = (codes[x:y] & np.uint64(0xFFFFFFFF)).astype(np.uint32)
                    rows.append((int(shard[x]), pack([bytes([side]), _planes(np.diff(own, prepend=np.uint32(0))), _planes(n[x:y].astype(np.uint32))])))
            yield _batch(PAIRS, rows)

        for b in batches:
            for text in as_bytes(b.column(0)):
                ids = head.look(text.lower().split())
                held += [_END, ids]
                size += len(ids) + 1
                if size > FLUSH:
                    held.append(_END)
                    yield from full()
                    # a text's end is beside the next text's start in the list, never beside another end
                    held, size = [], 0
        if held:
            held.append(_END)
            yield from full()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sides = None, ([], [])

        def done() -> Iterator[pa.RecordBatch]:
            (right, n), (left, k) = (_summed(np.concatenate([x for x, _ in side]), np.concatenate([x for _, x in side])) if side else (np.zeros(0, np.uint32), np.zeros(0, np.int64)) for side in sides)
            words = np.unique(np.concatenate([right >> np.uint32(16), left >> np.uint32(16)]))
            # blocks of whole words
            r, s = np.searchsorted(right >> np.uint32(16), words), np.searchsorted(left >> np.uint32(16), words)
            size = np.append(r, len(right)) + np.append(s, len(left))
            start = 0
            while start < len(words):
                stop = max(int(np.searchsorted(size, size[start] + (1 << 20))), start + 1)
                stop = min(stop, len(words))
                x, y = (slice(e[start], e[stop] if stop < len(words) else total) for e, total in ((r, len(right)), (s, len(left))))
                parts = [words[start:stop].astype("<u2").tobytes()]
                for codes, counts, own in ((right[x], n[x], r), (left[y], k[y], s)):
                    parts += [np.diff(np.append(own, len(right) if own is r else len(left))[start:stop + 1]).astype("<u4").tobytes(), (codes & np.uint32(0xFFFF)).astype("<u2").tobytes(), counts.astype("<u8").tobytes()]
                yield _batch(PAIRS, [(now, pack(parts))])
                start = stop

        for b in batches:
            for shard, blob in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if now is not None and shard != now:
                    yield from done()
                    sides = ([], [])
                now = shard
                side, codes, n = unpack(blob)
                sides[side[0]].append((np.cumsum(_from_planes(codes, "<u4"), dtype=np.uint32), _from_planes(n, "<u4").astype(np.int64)))
        if now is not None:
            yield from done()

    return cut(docs.select("text").mapInArrow(send, PAIRS).repartition(shards, "shard").sortWithinPartitions("shard").mapInArrow(merge, PAIRS))


_END = np.array([END], np.uint16)


def _batch(ddl: str, rows: list[tuple]) -> pa.RecordBatch:
    schema = arrow_schema(ddl)
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)


def _entries(blob: bytes) -> tuple[np.ndarray, tuple[np.ndarray, ...], tuple[np.ndarray, ...]]:
    """(words, right side, left side) of a block; a side: (word's place, neighbour, times)."""
    words, *sides = unpack(blob)
    words = np.frombuffer(words, "<u2")
    return words, *((np.repeat(np.arange(len(words)), np.frombuffer(a, "<u4")), np.frombuffer(b, "<u2"), np.frombuffer(c, "<u8").astype(np.float64)) for a, b, c in (sides[:3], sides[3:]))


# Exchange ----------------------------------------------------------------------------------


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


def likelihood(table: np.ndarray) -> float:
    """Log-likelihood of the class bigrams and emissions, but for what no move changes."""
    return float(_xlogx(table).sum() - _xlogx(table.sum(0)).sum() - _xlogx(table.sum(1)).sum())


def profiles(blob: bytes, group: np.ndarray, side: int = SIDE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(words, right, left, self): how often each class follows and precedes a word, and the
    word itself does (counted in ``self`` alone)."""
    words, *sides = _entries(blob)
    out = []
    for at, other, n in sides:
        same = other == words[at]
        own = np.bincount(at[same], n[same], len(words))
        out.append((np.bincount(at * side + group[other], n, len(words) * side).reshape(len(words), side), own))
    (right, own), (left, _) = out
    at = np.arange(len(words))
    right[at, group[words]] -= own
    left[at, group[words]] -= own
    return words, right, left, own


def weights_of(table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log-likelihood, by class, of what follows and what precedes a word: [class, neighbour]."""
    smooth, classes = table + 0.5, len(table) - 2
    out, into = smooth.sum(1), smooth.sum(0)
    right = np.log(smooth / out[:, None])[:classes] - np.log(into)[:classes, None]  # with the word's emission
    left = np.log(smooth / out[:, None]).T[:classes]
    return right, left


def candidates(table: np.ndarray, right: np.ndarray, left: np.ndarray, own_n: np.ndarray, own: np.ndarray | None) -> np.ndarray:
    """The class of highest likelihood for each word, other than ``own``, all else as it is."""
    after, before = weights_of(table)
    score = right @ after.T + left @ before.T + own_n[:, None] * after.diagonal()
    if own is not None:
        score[np.arange(len(own)), own] = -np.inf
    return score.argmax(1)


def gains(table: np.ndarray, right: np.ndarray, left: np.ndarray, own_n: np.ndarray, own: np.ndarray, to: np.ndarray) -> np.ndarray:
    """What putting each word into class ``to`` adds to the likelihood of all the others, the
    word taken out of class ``own`` before. Exact for one move at a time."""
    at = np.arange(len(own))
    back = (to == own)[:, None]
    rows = table[to] - np.where(back, right, 0)
    columns = table.T[to] - np.where(back, left, 0)
    own_left, own_right = left[at, to], right[at, to]
    stays = back[:, 0]
    rows[at, own] -= own_left + np.where(stays, own_n, 0)
    columns[at, own] -= own_right + np.where(stays, own_n, 0)
    gain = (_xlogx(rows + right) - _xlogx(rows)).sum(1) + (_xlogx(columns + left) - _xlogx(columns)).sum(1)
    cell = rows[at, to]
    gain += _xlogx(cell + own_right + own_left + own_n) - _xlogx(cell + own_right) - _xlogx(cell + own_left) + _xlogx(cell)
    out, into = rows.sum(1) + own_left, columns.sum(1) + own_right  # whole, wherever the word goes
    return gain - _xlogx(out + right.sum(1) + own_n) + _xlogx(out) - _xlogx(into + left.sum(1) + own_n) + _xlogx(into)


def class_table(pairs: DataFrame, group: np.ndarray, side: int = SIDE) -> np.ndarray:
    """Class bigrams of all words, ends and words without a class included."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(side * side)
        for b in batches:
            for blob in b.column(1).to_pylist():
                words, (at, other, n), (back, before, k) = _entries(blob)
                own = group[words].astype(np.int64)
                seen += np.bincount(own[at] * side + group[other], n, len(seen))
                outer = before >= HEAD  # not listed from the other end
                seen += np.bincount(group[before[outer]].astype(np.int64) * side + own[back[outer]], k[outer], len(seen))
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(seen[at].astype(np.int64))], schema=arrow_schema("cell long, n long"))

    rows = pairs.mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
    table = np.zeros(side * side)
    table[rows["cell"]] = rows["n"]
    return table.reshape(side, side)


def moves(pairs: DataFrame, group: np.ndarray, table: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word, class, gain) of the words low <= word < high whose likelihood rises by a move;
    words without a class always move. Each word is looked at as if it moved alone."""
    least = max(1e-9, 1e-13 * float(_xlogx(table.sum())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for blob in b.column(1).to_pylist():
                words, right, left, own_n = profiles(blob, group, len(table))
                keep = (words >= low) & (words < high)
                words, right, left, own_n = words[keep].astype(np.int64), right[keep], left[keep], own_n[keep]
                own = group[words].astype(np.int64)
                new = own == len(table) - 1
                to = candidates(table, right, left, own_n, np.where(new, 0, own) if not new.any() else None)
                gain = np.full(len(words), np.inf)
                old = np.flatnonzero(~new)
                if len(old):
                    part = right[old], left[old], own_n[old], own[old]
                    gain[old] = gains(table, *part, to[old]) - gains(table, *part, own[old])
                good = (gain > least) & (to != own)
                yield pa.RecordBatch.from_arrays([pa.array(words[good], pa.int32()), pa.array(to[good], pa.int32()), pa.array(gain[good])], schema=arrow_schema("word int, to int, gain double"))

    rows = pairs.mapInArrow(run, "word int, to int, gain double").toPandas().sort_values("word")
    return rows["word"].to_numpy(), rows["to"].to_numpy(), rows["gain"].to_numpy()


def exchange(pairs: DataFrame, n_words: int, tolerance: float = TOLERANCE, classes: int = CLASSES) -> tuple[np.ndarray, np.ndarray]:
    """(class of each symbol, class bigrams). The first ``classes`` words are classes of their own;
    the others are inserted by frequency in batches; then words are exchanged, all at once, for
    as long as a round raises the likelihood by ``tolerance`` of it. Where the moves together
    lower it, only the better half of them is made, and so on."""
    group = np.full(HEAD + 2, classes + 1, np.uint8)
    group[END] = classes
    first = min(classes, n_words)
    group[:first] = np.arange(first)
    table = class_table(pairs, group, classes + 2)
    while first < n_words:
        last = min(n_words, first * GROWTH)
        word, to, _ = moves(pairs, group, table, first, last)
        group[word] = to
        table = class_table(pairs, group, classes + 2)
        first = last
    now = likelihood(table)
    while n_words > 1:
        word, to, gain = moves(pairs, group, table, 0, n_words)
        order = np.argsort(-gain, kind="stable")
        after = now
        while len(order):
            new = group.copy()
            new[word[order]] = to[order]
            changed = class_table(pairs, new, classes + 2)
            after = likelihood(changed)
            if after > now:
                group, table = new, changed
                break
            order = order[:len(order) // 2]
        if not len(order) or after - now < tolerance * abs(now):
            break
        now = after
    return group, table


# Mail --------------------------------------------------------------------------------------

MAIL = "to int, envelope string, shard int, blob binary"
DOCS, TYPES = -1, -2


def _send(head: Head, group: np.ndarray, shards: int):
    """Documents to envelopes: words outside the head go to their shards, with the classes on
    both sides of each place in a training text; the documents, as numbers, go along."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: list[tuple] = []
        size = 0

        def full() -> pa.RecordBatch:
            place: dict[bytes, int] = {}
            lines, symbols, others = [], [_END], []
            for _, _, text, _ in own:
                words = text.lower().split()
                ids = head.look(words)
                lines.append(len(words))
                symbols += [ids, _END]
                others += [place.setdefault(words[i], len(place)) for i in np.flatnonzero(ids == REST).tolist()]
            s, other = np.concatenate(symbols), np.array(others, np.int64)
            words = list(place)
            shard = np.fromiter((zlib.crc32(w) % shards for w in words), np.int64, len(words))
            order = np.argsort(shard, kind="stable")
            number = np.empty(len(words), np.int64)
            number[order] = np.arange(len(words))
            other = number[other]
            at = np.flatnonzero(s == REST)
            trains = np.repeat([not r[1] for r in own], np.array(lines) + 1)[at - 1]
            by = np.argsort(other[trains], kind="stable")
            beside = np.stack([group[s[at - 1]], group[s[at + 1]]], 1)[trains][by]
            n = np.bincount(other[trains], minlength=len(words))
            upto = np.concatenate([[0], np.cumsum(n)])
            bounds = np.searchsorted(shard[order], np.arange(shards + 1)).tolist()
            mail, name = [], own[0][3]
            for k in range(shards):
                a, b = bounds[k], bounds[k + 1]
                if a < b:
                    mine = [words[i] for i in order[a:b].tolist()]
                    mail.append((k, name, k, pack([_planes(np.array(list(map(len, mine)), "<u4")), b"".join(mine), _planes(n[a:b].astype("<u4")), beside[upto[a]:upto[b]].T.tobytes()], 6)))
            ids = [b"" if r[0] is None else int(r[0]).to_bytes(8, "little", signed=True) for r in own]
            docs = [np.array(lines, "<u4").tobytes(), bytes(bool(r[1]) for r in own), _planes(s.astype("<u2")), _planes(other.astype("<u4")), *ids]
            return _batch(MAIL, [*mail, (zlib.crc32(name.encode()) % shards, name, DOCS, pack(docs, 6))])

        for b in batches:
            for row in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), as_bytes(b.column(2)), b.column(3).to_pylist(), strict=True):
                if own and size + len(row[2]) > ENVELOPE_BYTES:
                    yield full()
                    own, size = [], 0
                own.append(row)
                size += len(row[2]) + 64
        if own:
            yield full()

    return run


def _answer(table: np.ndarray):
    """In the one task that hears of a word from everywhere: its count in the training texts
    and the class of highest likelihood. The answers go back in the order of the questions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        after, before = weights_of(table)
        weights = np.concatenate([before.T, after.T])  # what precedes, then what follows

        def done(shard: int, number: dict, asked: list, counts: list, sides: list) -> Iterator[pa.RecordBatch]:
            total, word = np.zeros(len(number), np.int64), np.concatenate([np.repeat(a, n) for (_, a), n in zip(asked, counts, strict=True)])
            for (_, a), n in zip(asked, counts, strict=True):
                total[a] += n
            left, right = (np.concatenate(x) for x in zip(*sides, strict=True))
            order = np.argsort(word, kind="stable")
            word, left, right = word[order], left[order], right[order]
            classes = np.zeros(len(number), np.uint8)
            for start in range(0, len(number), 1 << 14):
                a, b = np.searchsorted(word, [start, start + (1 << 14)])
                size = min(1 << 14, len(number) - start)
                row = (word[a:b] - start) * (2 * SIDE)
                seen = np.bincount(np.concatenate([row + left[a:b], row + SIDE + right[a:b]]), minlength=size * 2 * SIDE).reshape(size, 2 * SIDE)
                classes[start:start + size] = (seen @ weights).argmax(1)
            for name, a in asked:
                yield _batch(MAIL, [(0, name, shard, pack([_planes(total[a].astype("<u8")), np.where(total[a] > 0, classes[a], UNSEEN).astype(np.uint8).tobytes()], 6))])
            yield _batch(MAIL, [(0, "", TYPES, np.bincount(classes[total > 0], minlength=CLASSES).astype("<u8").tobytes())])

        now, held = None, ({}, [], [], [])
        for b in batches:
            for _, envelope, shard, blob in zip(*(x.to_pylist() for x in b.columns), strict=True):
                if shard == DOCS:
                    yield _batch(MAIL, [(0, envelope, DOCS, blob)])
                    continue
                if now is not None and shard != now:
                    yield from done(now, *held)
                    held = ({}, [], [], [])
                now = shard
                number, asked, counts, sides = held
                lengths, words, n, beside = unpack(blob)
                ends = np.cumsum(_from_planes(lengths, "<u4")).tolist()
                asked.append((envelope, np.fromiter((number.setdefault(words[a:b], len(number)) for a, b in zip([0, *ends[:-1]], ends, strict=True)), np.int64, len(ends))))
                counts.append(_from_planes(n, "<u4").astype(np.int64))
                sides.append(np.frombuffer(beside, np.uint8).reshape(2, -1).astype(np.int64))
        if now is not None:
            yield from done(now, *held)

    return run


#: A document with its classes; or the times n that class b follows a in training texts (a >= 0),
#: or the number of types in class b (a = -1).
CODED = "doc_id long, held_out boolean, n_tokens long, n_known long, plain double, classes binary, a int, b int, n long"


def _coded(head: Head, group: np.ndarray):
    """Put each envelope's documents together; count the class bigrams of those that train."""
    schema = arrow_schema(CODED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, types = np.zeros(SIDE * SIDE, np.int64), np.zeros(CLASSES, np.int64)
        logs = np.append(np.log10(head.n + 1), [0.0] * (HEAD + 2 - len(head.n)))

        def out(rows: list[tuple[int, bytes]]) -> Iterator[pa.RecordBatch]:
            n, kinds, docs = [], [], None
            for shard, blob in sorted(rows, key=lambda r: r[0]):
                if shard == TYPES:
                    types[:] += np.frombuffer(blob, "<i8")
                elif shard == DOCS:
                    docs = list(unpack(blob))
                else:
                    x, y = unpack(blob)
                    n.append(_from_planes(x, "<u8"))
                    kinds.append(np.frombuffer(y, np.uint8))
            if docs is None:
                return
            lines, held = np.frombuffer(docs[0], "<u4").astype(np.int64), np.frombuffer(docs[1], np.bool_)
            s, other = _from_planes(docs[2], "<u2"), _from_planes(docs[3], "<u4")
            n, kinds = (np.concatenate(x) if x else np.zeros(0, np.uint8) for x in (n, kinds))
            classes, plain, at = group[s], logs[s], np.flatnonzero(s == REST)
            classes[at], plain[at] = kinds[other], np.log10(n[other] + 1.0)
            known = (classes != UNSEEN) & (s != END)
            starts = np.concatenate([[1], 1 + np.cumsum(lines + 1)])  # after the end before each text
            train = np.repeat(~held, lines + 1)  # a text's words and its end, with what precedes each
            pairs[:] += np.bincount(classes[:-1][train].astype(np.int64) * SIDE + classes[1:][train], minlength=len(pairs))
            sums, found = (np.add.reduceat(np.append(x, 0), starts[:-1]) for x in (np.where(s == END, 0.0, plain), known.astype(np.int64)))
            ids = [int.from_bytes(x, "little", signed=True) if x else None for x in docs[4:]]
            raw = classes.tobytes()
            texts = [raw[a:a + k] for a, k in zip(starts[:-1].tolist(), lines.tolist(), strict=True)]
            none = [None] * len(ids)
            columns = ids, held.tolist(), (lines + 1).tolist(), found.tolist(), sums.tolist(), texts, none, none, none
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(columns, schema, strict=True)], schema=schema)

        now, rows = None, []
        for b in batches:
            for envelope, shard, blob in zip(*(b.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
                if now is not None and envelope != now:
                    yield from out(rows)
                    rows = []
                now = envelope
                rows.append((shard, blob))
        if rows:
            yield from out(rows)
        at = np.flatnonzero(pairs)
        cells = [(int(x) // SIDE, int(x) % SIDE, int(pairs[x])) for x in at] + [(-1, k, int(x)) for k, x in enumerate(types) if x]
        yield _batch(CODED, [(None,) * 6 + c for c in cells])

    return run


@dataclass
class Model:
    """What scoring needs in every task; SIDE squared bounds its size."""

    move: np.ndarray  # log10 P(class | class before), ends last
    room: np.ndarray  # log10 of a class's tokens and types and one: the divisor of its emissions
    unseen: np.ndarray  # the class of a word never seen, by the class before
    base_rest: float
    end_base: float
    train_tokens: int
    end_known: bool


def model_of(cells: list[tuple[int, int, int]], head_types: np.ndarray, words: int, kinds: int, texts: int) -> Model:
    """From class bigrams (a, b, n) and types (-1, class, n) of all training texts. A class emits
    a word with n + 1 of its tokens and types and one, the one being kept for unseen words; an
    unseen word is in the class where it is likeliest after the class before it."""
    size = CLASSES + 1
    table, types = np.zeros((size, size)), head_types.astype(np.float64)
    for a, b, n in cells:
        if a < 0:
            types[b] += n
        else:
            table[a, b] += n
    into = table.sum(0)
    unigram = (into + 1) / (into.sum() + size)
    move = np.log10((table + PRIOR * unigram) / (table.sum(1, keepdims=True) + PRIOR))
    room = np.log10(into[:CLASSES] + types + 1)
    base_rest = math.log10(words + texts + kinds + (texts > 0) + 1)
    return Model(move, room, (move[:, :CLASSES] - room).argmax(1), base_rest, math.log10(texts + 1) - base_rest, words + texts, texts > 0)


def text_score(model: Model, raw: bytes) -> float:
    """log10 probability of a text's classes, and of its words but for their log10(n + 1)."""
    path = np.concatenate([[ENDS], np.frombuffer(raw, np.uint8), [ENDS]]).astype(np.int64)
    for k in np.flatnonzero(path == UNSEEN).tolist():
        path[k] = model.unseen[path[k - 1]]
    return float(model.move[path[:-1], path[1:]].sum() - model.room[path[1:-1]].sum())


SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"


def fit(docs: DataFrame) -> tuple[Head, np.ndarray, DataFrame, Model]:
    """Learn from the rows of ``docs`` that are not held out: (head, class of each symbol, all
    rows with their classes, model). The third is a written table."""
    spark = docs.sparkSession
    rows = numbered(docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text"))).withColumn("held_out", held_out(F.col("doc_id")))
    train = rows.filter(~F.col("held_out"))
    shards = shards_for(spark, text_bytes(rows), SHARD_BYTES)
    counts = cut(word_counts(train))
    words, kinds = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    texts = train.count()
    head = head_of(counts)
    group, table = exchange(neighbours(train, head, shards), len(head.words))
    sent = rows.select("doc_id", "held_out", "text", "__rid").mapInArrow(_send(head, group, shards), MAIL).repartition(shards, "to").sortWithinPartitions("to", "shard")
    answers = sent.mapInArrow(_answer(table), MAIL).repartition(shards, "envelope").sortWithinPartitions("envelope")
    coded = cut(answers.mapInArrow(_coded(head, group), CODED))
    cells = coded.filter("a is not null").groupBy("a", "b").agg(F.sum("n").alias("n")).collect()
    types = np.bincount(group[:len(head.words)], minlength=SIDE)[:CLASSES]
    return head, group, coded.filter("a is null"), model_of([tuple(c) for c in cells], types, words, kinds, texts)


def scored(coded: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, base_score, score of rows with their classes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = arrow_schema(SCORED)
        for b in batches:
            n, known, plain = (b.column(i).to_numpy(zero_copy_only=False) for i in (2, 3, 4))
            score = np.array([text_score(model, x) for x in b.column(5).to_pylist()], np.float64) + plain
            base = plain - (n - 1) * model.base_rest + model.end_base
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(known + model.end_known, pa.int64()), pa.array(base), pa.array(score)], schema=schema)

    return coded.select("doc_id", "held_out", "n_tokens", "n_known", "plain", "classes").mapInArrow(run, SCORED)


def lm_report(docs: DataFrame) -> DataFrame:
    """Score every row of ``docs`` by a model of the rows that are not held out.

    Null and empty texts are one end token. Repeated rows train twice and score alike; a
    null doc_id trains; an empty table gives none; without training rows every count is 0.
    """
    _, _, coded, model = fit(docs)
    return scored(coded, model).select("doc_id", "held_out", "n_tokens", "n_known", F.lit(model.train_tokens).cast("long").alias("train_tokens"), "base_score", "score")
