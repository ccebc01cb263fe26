"""Line dedup by an exact set-similarity join.

Every line is the set of its lower-cased (A-Z) words. Two lines match at a Jaccard similarity of `threshold`
or more; of lines that match, later ones are removed: a line goes if any earlier line matches it, earlier
meaning a smaller document id, then line number. Lines without words stay.

Lines are first reduced to distinct sets (by 128 bits of their tokens). Tokens are ordered by rarity: by the token's
share of a table of hashed frequencies of fixed size, filled from all lines, ties by hash. A set is indexed under its
rarest tokens (its prefix: n - ceil(t n) + 1 of n), and sets that meet under a token are kept if their sizes (length
filter), the tokens left after the shared one (positional filter) and a sketch of the set (64 to 256 bits by size)
allow the threshold. What is left is verified on the sets themselves.

A token under which more than `GROUP` sets meet is not met: its sets are dealt out anew by the token and the next one
they share (sets that match share two tokens of a prefix longer by one), then by three, and last in random blocks.
Only whether an earlier match exists matters, so a first round verifies the `FIRST` closest candidates of a set under
each key; sets that remain unmatched and had more, or met a block only, are asked again against all sets under their
keys. No group is ever held whole beyond these bounds, and no pairs of a group are listed beyond `FIRST` a set.

Ids: the document id tells documents apart where it is unique and not null; otherwise rows get ids of their own,
written first, ordered by document id (nulls first). A null text stays null and has no lines. A document that
loses every line that holds words is removed itself; one that had none stays. Repeated rows: the first is kept.
Tokens are 64-bit hashes. An empty table gives no rows. Extra columns are carried along, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import meeting
from .common import discard, numbered, pick, place, table, written
from .words import buffers, distinct, mix, word_hashes

THRESHOLD = 0.8
FIRST = 8
GROUP = 4096
LEVELS = 3  # most tokens in a key
BUCKETS = 1 << 18
CHUNK = 1 << 12
COMMON = 1000  # a token with more than one in so many occurrences is left out of the sketch
SETS_HELD = 100_000
TOKENS_HELD = 1 << 17
BROADCAST_ROWS = 1_000_000
BROADCAST_BYTES = 32 << 20
PAIRS_HELD = 1 << 18
MAP_BITS = 23
WIDE = 4  # most words of 64 bits in a sketch

_U = np.uint64
SETS = "doc long, line int, s0 long, s1 long, n int, tokens binary"
_SET_NAMES = ["doc", "line", "s0", "s1", "n", "tokens"]
_RECORD = np.dtype([("key", "<u8"), ("doc", "<i8"), ("line", "<i4"), ("n", "<i4"), ("pos", "<i4"), ("ask", "u1")] + [(f"s{k}", "<u8") for k in range(WIDE)])
_MET = "doc long, line int, doc2 long, line2 int, c long"


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def set_keys(tokens: np.ndarray, n: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of each set of distinct tokens, whatever their order."""
    one = np.add.reduceat(mix(tokens + _U(1)), start) + mix(n.astype(_U))
    two = np.add.reduceat(mix(tokens ^ _U(0xD6E8FEB86659FD93)), start)
    return one.view(np.int64), two.view(np.int64)


class Sets:
    """Rows of sets; a set that was seen before within the task has null tokens."""

    def __init__(self):
        self.seen: set[tuple[int, int]] = set()

    def batch(self, doc: np.ndarray, line: np.ndarray, group: np.ndarray, tokens: np.ndarray) -> pa.RecordBatch:
        """`group` (sorted) says to which row of doc and line a token belongs; every row has tokens."""
        n = np.bincount(group, minlength=len(doc))
        start = np.cumsum(n) - n
        s0, s1 = set_keys(tokens, n, start)
        body, out = tokens.astype("<u8").tobytes(), []
        for s, a, b in zip(zip(s0.tolist(), s1.tolist()), (8 * start).tolist(), (8 * (start + n)).tolist()):
            if s in self.seen:
                out.append(None)
            else:
                out.append(body[a:b])
                if len(self.seen) < SETS_HELD:
                    self.seen.add(s)
        return pa.record_batch([pa.array(doc.astype(np.int64)), pa.array(line.astype(np.int32)), pa.array(s0), pa.array(s1), pa.array(n.astype(np.int32)), pa.array(out, pa.binary())], names=_SET_NAMES)


def _line_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row a line that holds words."""
    sets = Sets()
    for batch in batches:
        docs, texts = batch["doc"].to_numpy(), batch["text"].cast(pa.binary()).to_pylist()
        for i, j in buffers(texts):
            h, text, line, lines = word_hashes(texts[i:j])
            if not len(h):
                continue
            row = (np.cumsum(lines) - lines)[text] + line
            row, h = distinct(row, h)
            fresh = np.r_[True, row[1:] != row[:-1]]
            own = row[fresh]
            at = np.searchsorted(np.cumsum(lines), own, side="right")
            yield sets.batch(docs[i:j][at], own - (np.cumsum(lines) - lines)[at], np.cumsum(fresh) - 1, h)


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of few rows and, but for a single set, of few tokens."""
    end, i = np.cumsum(batch["n"].to_numpy().astype(np.int64)), 0
    while i < len(end):
        most = (end[i - 1] if i else 0) + TOKENS_HELD
        j = min(i + 4096, max(i + 1, int(np.searchsorted(end, most, side="right"))))
        yield batch.slice(i, j - i)
        i = j


def _flat(col: pa.Array) -> np.ndarray:
    """All tokens of a binary column without nulls, as one array."""
    return np.frombuffer(b"".join(col.to_pylist()), "<u8")


def _chunks(held: np.ndarray, extra: int = 0) -> Iterator[pa.RecordBatch]:
    rows = [(i // CHUNK, held[i : i + CHUNK].tobytes()) for i in range(0, len(held), CHUNK) if held[i : i + CHUNK].any()]
    if extra:
        rows.append((-1, np.array([extra], np.int64).tobytes()))
    if rows:
        yield pa.record_batch([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], names=["chunk", "counts"])


def _joined(partial: DataFrame, kind, join) -> dict[int, np.ndarray]:
    """Arrays of fixed size, filled by tasks chunk by chunk, joined element by element."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for c, b in zip(batch["chunk"].to_pylist(), batch["counts"].to_pylist()):
                held[c] = join(held[c], np.frombuffer(b, kind)) if c in held else np.frombuffer(b, kind)
        for c, b in held.items():
            yield pa.record_batch([pa.array([c], pa.int32()), pa.array([b.tobytes()], pa.binary())], names=["chunk", "counts"])

    rows = partial.repartition("chunk").mapInArrow(run, "chunk int, counts binary").toArrow()
    return {c: np.frombuffer(b, kind) for c, b in zip(rows["chunk"].to_pylist(), rows["counts"].to_pylist())}


def hashed_frequencies(sets: DataFrame, threshold: float) -> tuple[np.ndarray, int]:
    """(occurrences by bucket of the tokens of all sets: BUCKETS numbers, whatever the input; length of all prefixes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, prefixes = np.zeros(BUCKETS, np.int64), 0
        for batch in batches:
            for part in _slices(batch):
                held += np.bincount((_flat(part["tokens"]) % _U(BUCKETS)).astype(np.int64), minlength=BUCKETS)
                prefixes += int(prefix_size(part["n"].to_numpy().astype(np.int64), threshold).sum())
        yield from _chunks(held, prefixes)

    got = _joined(sets.select("n", "tokens").mapInArrow(run, "chunk int, counts binary"), np.int64, np.add)
    out = np.zeros(BUCKETS, np.int64)
    total = int(got.pop(-1, np.zeros(1, np.int64))[0])
    for c, b in got.items():
        out[c * CHUNK : (c + 1) * CHUNK] = b
    return out, total


def sketches(tok: np.ndarray, common: np.ndarray, n: np.ndarray, start: np.ndarray) -> list[np.ndarray]:
    """WIDE words a set: token bits in the first 1, 2 or 4 words by the set's size, so that a wider sketch folds onto a narrower one."""
    width = np.repeat(_width(n), n).astype(_U)
    h = mix(tok)
    bit = np.where(common[(tok % _U(BUCKETS)).astype(np.int64)], _U(0), _U(1) << (h & _U(63)))
    if not len(n) or n.max() <= 64:
        return [np.bitwise_or.reduceat(bit, start)] + [np.zeros(len(n), _U)] * (WIDE - 1)
    word = (h >> _U(6)) % width
    return [np.bitwise_or.reduceat(np.where(word == _U(k), bit, _U(0)), start) for k in range(WIDE)]


def _width(n: np.ndarray) -> np.ndarray:
    return np.where(n <= 64, 1, np.where(n <= 128, 2, WIDE))


def sketch_gap(sk: list[np.ndarray], n: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Bits in which the sketches of sets i and j differ, at the width of the narrower one: at most their symmetric difference."""
    width = np.minimum(_width(n[i]), _width(n[j]))
    out = np.zeros(len(i), np.int64)
    for w in (1, 2, WIDE):
        at = np.flatnonzero(width == w)
        if len(at):
            for k in range(w):
                a, b = (np.bitwise_or.reduce([x[r[at]] for x in sk[k::w]]) for r in (i, j))
                out[at] += np.bitwise_count(a ^ b)
    return out


def prefix_size(n: np.ndarray, threshold: float) -> np.ndarray:
    return n - np.ceil(n * threshold - 1e-9).astype(np.int64) + 1


class Order:
    """The order of tokens by rarity, and the keys that are dealt out further: (sorted keys, counts) of each level."""

    def __init__(self, frequency: np.ndarray, threshold: float):
        self.rank = np.empty(BUCKETS, _U)
        self.rank[np.argsort(frequency, kind="stable")] = np.arange(BUCKETS, dtype=_U)
        self.common = frequency * COMMON > max(1, frequency.sum())
        self.threshold, self.group = threshold, GROUP
        self.hot: list[tuple[np.ndarray, np.ndarray]] = []

    def records(self, batch: pa.RecordBatch, levels: range, marked: np.ndarray | None = None) -> Iterator[np.ndarray]:
        """Records of the keys of the given levels (1: one token; LEVELS + 1: blocks). With a bitmap `marked` only sets with `ask` ask, and others are sent where a key is marked."""
        n, tok = batch["n"].to_numpy().astype(np.int64), _flat(batch["tokens"]).astype(_U)
        asks = batch["ask"].to_numpy(zero_copy_only=False).astype(np.uint8) if marked is not None else np.ones(len(n), np.uint8)
        at, start = np.repeat(np.arange(len(n)), n), np.cumsum(n) - n
        sk = sketches(tok, self.common, n, start)
        key = np.sort((at.astype(_U) << _U(50)) | (self.rank[(tok % _U(BUCKETS)).astype(np.int64)] << _U(32)) | (tok & _U(0xFFFFFFFF)))
        token = mix((key & _U(0xFFFFFFFF)) + _U(1))
        prefix = prefix_size(n, self.threshold)
        doc, line = batch["doc"].to_numpy(), batch["line"].to_numpy()

        def out(key: np.ndarray, at: np.ndarray, pos: np.ndarray, ask: np.ndarray) -> np.ndarray:
            if marked is not None:
                send = np.flatnonzero(ask.astype(bool) | bitmap_has(marked, key))
                key, at, pos, ask = key[send], at[send], pos[send], ask[send]
            rows = np.empty(len(key), _RECORD)
            rows["key"], rows["doc"], rows["line"], rows["n"], rows["pos"], rows["ask"] = key, doc[at], line[at], n[at], pos, ask
            for k in range(WIDE):
                rows[f"s{k}"] = sk[k][at]
            return rows

        pos = np.arange(len(key)) - start[at]
        own = np.flatnonzero(pos < prefix[at])
        last, at, key = own, at[own], token[own]  # the flat place of a key's last token
        for level in range(1, LEVELS + 2):
            hot, count = self.hot[level - 1] if level <= len(self.hot) else (np.zeros(0, _U), None)
            spot = np.minimum(np.searchsorted(hot, key), max(0, len(hot) - 1))
            more = hot[spot] == key if len(hot) else np.zeros(len(key), bool)
            if level in levels and not more.all():
                yield out(key[~more], at[~more], (last - start[at] - (level - 1))[~more], asks[at[~more]])
            if not more.any():
                return
            key, at, last, spot = key[more], at[more], last[more], spot[more]
            if level == LEVELS:
                if level + 1 in levels:
                    blocks = -(-count[spot] // self.group)
                    block = (mix(doc[at].astype(_U) * _U(3) + line[at].astype(_U)) % blocks.astype(_U)).astype(np.int64)
                    place_ = last - start[at] - (level - 1)
                    salted = lambda k, b: mix(k + _U(0x9E3779B97F4A7C15) * (b + 1).astype(_U))
                    none = asks[at] if marked is None else np.zeros(len(at), np.uint8)
                    yield out(salted(key, block), at, place_, none)
                    if marked is not None and (who := np.flatnonzero(asks[at])).size:  # every block is asked
                        many = np.repeat(who, blocks[who])
                        nth = np.arange(len(many)) - np.repeat(np.cumsum(blocks[who]) - blocks[who], blocks[who])
                        yield out(salted(key[many], nth), at[many], place_[many], np.ones(len(many), np.uint8))
                return
            # the next token of the longer prefix
            end = np.minimum(prefix[at] + level, n[at])
            follow = np.maximum(end - (last - start[at]) - 1, 0)
            rep = np.repeat(np.arange(len(key)), follow)
            last = last[rep] + 1 + np.arange(len(rep)) - np.repeat(np.cumsum(follow) - follow, follow)
            key, at = mix(key[rep] * _U(3) + token[last]), at[rep]


def bitmap_has(marked: np.ndarray, key: np.ndarray) -> np.ndarray:
    bit = (key >> _U(64 - MAP_BITS)).astype(np.int64)
    return (marked[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1 == 1


class Met:
    """The records of a part with the filters on pairs of them."""

    def __init__(self, rows: np.ndarray, threshold: float):
        clip = (1 << 20) - 1
        rows = rows[np.argsort((rows["key"] & ~_U(clip)) | np.minimum(rows["n"], clip).astype(_U), kind="stable")]
        self.doc, self.line, self.n, self.pos, self.ask = rows["doc"], rows["line"].astype(np.int64), rows["n"].astype(np.int64), rows["pos"].astype(np.int64), rows["ask"].astype(bool)
        self.sk = [rows[f"s{k}"].copy() for k in range(WIDE)]
        self.threshold = threshold
        self.key = rows["key"]
        group = rows["key"] >> _U(20)
        edge = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
        self.group = np.repeat(np.arange(len(edge)), np.diff(np.r_[edge, len(rows)]))
        # rows of a group are sorted by size: the first and last that the length filter allows
        size, wide = np.minimum(self.n, clip), 2 * clip + 2
        place_ = self.group * wide + size
        self.low = np.searchsorted(place_, self.group * wide + np.where(size == clip, 0, np.ceil(size * threshold - 1e-9).astype(np.int64)), side="left")
        self.high = np.searchsorted(place_, self.group * wide + np.minimum(np.floor(size / threshold + 1e-9).astype(np.int64), clip), side="right")

    def allowed(self, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(later, earlier, sketch gap) of the pairs that pass the positional filter and the sketches."""
        left = self.n - self.pos
        total = self.n[i] + self.n[j]
        need = np.ceil(total * self.threshold / (1 + self.threshold) - 1e-9).astype(np.int64)
        at = np.flatnonzero((np.minimum(left[i], left[j]) >= need) & (self.key[i] == self.key[j]))
        i, j, most = i[at], j[at], (total - 2 * need)[at]
        gap = sketch_gap(self.sk, self.n, i, j)
        at = np.flatnonzero(gap <= most)
        i, j, gap = i[at], j[at], gap[at]
        late = (self.doc[i] > self.doc[j]) | ((self.doc[i] == self.doc[j]) & (self.line[i] > self.line[j]))
        i, j = np.where(late, i, j), np.where(late, j, i)
        at = np.flatnonzero((self.doc[i] != self.doc[j]) | (self.line[i] != self.line[j]))
        return i[at], j[at], gap[at]

    def pairs(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """All pairs within the length filter, a bounded number at a time; where only some rows ask, those of the asking rows."""
        if self.ask.all():
            who, first = np.arange(len(self.n)), np.arange(len(self.n)) + 1
        else:
            who = np.flatnonzero(self.ask)
            first = self.low[who]
        many = np.maximum(self.high[who] - first, 0)
        done = np.cumsum(many)
        a = 0
        while a < len(who):
            b = max(a + 1, int(np.searchsorted(done, (done[a - 1] if a else 0) + PAIRS_HELD, side="right")))
            own = many[a:b]
            if own.sum():
                i = np.repeat(who[a:b], own)
                yield i, np.repeat(first[a:b], own) + np.arange(len(i)) - np.repeat(np.cumsum(own) - own, own)
            a = b

    def candidates(self, most: int | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(later, earlier), at most `most` of each later row, the closest first, and the later rows that had more."""
        held, size, over = (np.zeros(0, np.int64),) * 3, 0, [np.zeros(0, np.int64)]
        some, full = [], not self.ask.all()
        for i, j in self.pairs():
            got = self.allowed(i, j)
            if full:  # only rows that ask
                at = np.flatnonzero(self.ask[got[0]])
                got = tuple(x[at] for x in got)
            some.append(got)
            size += len(got[0])
            if most is not None and size > 4 * PAIRS_HELD:
                held, more = self._closest(some, most)
                over.append(more)
                some, size = [held], len(held[0])
        if not some:
            return (np.zeros(0, np.int64),) * 3
        if most is None:
            later, earlier, _ = (np.concatenate(x) for x in zip(*some))
            return later, earlier, later[:0]
        held, more = self._closest(some, most)
        return held[0], held[1], np.unique(np.concatenate([*over, more]))

    def _closest(self, some: list[tuple[np.ndarray, ...]], most: int) -> tuple[tuple[np.ndarray, ...], np.ndarray]:
        later, earlier, gap = (np.concatenate(x) for x in zip(*some))
        order = np.lexsort((self.line[earlier], self.doc[earlier], gap, later))
        later, earlier, gap = later[order], earlier[order], gap[order]
        first = np.r_[True, later[1:] != later[:-1]] if len(later) else np.zeros(0, bool)
        nth = np.arange(len(later)) - np.maximum.accumulate(np.where(first, np.arange(len(later)), 0)) if len(later) else later
        keep = nth < most
        return (later[keep], earlier[keep], gap[keep]), np.unique(later[~keep])


def _met(rows: np.ndarray, threshold: float, most: int | None, blocks: bool) -> Iterator[pa.RecordBatch]:
    """Candidates; a null partner says that there are more: beyond `most`, or in other blocks."""
    met = Met(rows, threshold)
    later, earlier, more = met.candidates(most)
    if blocks and most is not None:
        more = np.arange(len(met.n))
    line = met.line.astype(np.int32)
    if len(later):
        yield pa.record_batch([pa.array(met.doc[later]), pa.array(line[later]), pa.array(met.doc[earlier]), pa.array(line[earlier]), pa.nulls(len(later), pa.int64())], names=["doc", "line", "doc2", "line2", "c"])
    if len(more):
        yield pa.record_batch([pa.array(met.doc[more]), pa.array(line[more]), pa.nulls(len(more), pa.int64()), pa.nulls(len(more), pa.int32()), pa.nulls(len(more), pa.int64())], names=["doc", "line", "doc2", "line2", "c"])


def _refused(key: np.ndarray, count: np.ndarray) -> pa.RecordBatch:
    return pa.record_batch([pa.nulls(len(key), pa.int64()), pa.nulls(len(key), pa.int32()), pa.array(key.view(np.int64)), pa.nulls(len(key), pa.int32()), pa.array(count)], names=["doc", "line", "doc2", "line2", "c"])


def _round(sets: DataFrame, order: Order, levels: range, records: int, most: int | None, refuse: int | None, marked: np.ndarray | None = None) -> DataFrame:
    spark = sets.sparkSession
    held, n_parts = spark.sparkContext.broadcast((order, marked)), meeting.parts(spark, records)
    threshold, blocks = order.threshold, levels[0] > LEVELS

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order, marked = held.value
        yield from meeting.pack((rows for whole in batches for batch in _slices(whole) for rows in order.records(batch, levels, marked)), n_parts)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from meeting.meet(batches, _RECORD, refuse, lambda rows: _met(rows, threshold, most, blocks), _refused)

    columns = ["doc", "line", "n", "tokens"] + ["ask"] * (marked is not None)
    return meeting.deal(sets.select(*columns).mapInArrow(send, meeting.SENT)).mapInArrow(meet, _MET)


def _marks(sets: DataFrame, order: Order) -> np.ndarray:
    """A bitmap of fixed size of the keys of `sets`."""
    held = sets.sparkSession.sparkContext.broadcast(order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        on = np.zeros(1 << MAP_BITS, np.uint8)
        for whole in batches:
            for batch in _slices(whole):
                own = batch.append_column("ask", pa.array(np.ones(batch.num_rows, bool)))
                for rows in held.value.records(own, range(1, LEVELS + 2), np.zeros(1 << MAP_BITS - 3, np.uint8)):
                    on[(rows["key"] >> _U(64 - MAP_BITS)).astype(np.int64)] = 1
        yield from _chunks(np.packbits(on, bitorder="little"))

    got = _joined(sets.select("doc", "line", "n", "tokens").mapInArrow(run, "chunk int, counts binary"), np.uint8, np.bitwise_or)
    out = np.zeros(1 << MAP_BITS - 3, np.uint8)
    for c, b in got.items():
        out[c * CHUNK : (c + 1) * CHUNK] = b
    return out


def _verified(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """(doc, line) of later sets of candidate pairs that match."""
    ends = written(pairs.select("doc", "line").unionByName(pairs.select(F.col("doc2").alias("doc"), F.col("line2").alias("line"))).distinct(), "candidates")
    bodies = written(sets.select("doc", "line", "tokens").join(_small(ends), ["doc", "line"], "left_semi"), "candidate-sets")
    both = pairs.join(bodies, ["doc", "line"]).join(bodies.select(F.col("doc").alias("doc2"), F.col("line").alias("line2"), F.col("tokens").alias("tokens2")), ["doc2", "line2"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, 2048):
                batch = whole.slice(i, 2048)
                at = np.flatnonzero(jaccard(batch["tokens"], batch["tokens2"]) >= threshold - 1e-9)
                yield pa.record_batch([pa.array(batch["doc"].to_numpy()[at]), pa.array(batch["line"].to_numpy()[at])], names=["doc", "line"])

    return both.select("doc", "line", "tokens", "tokens2").mapInArrow(run, "doc long, line int").distinct()


def jaccard(a: pa.Array, b: pa.Array) -> np.ndarray:
    """Similarity of the sets of two binary columns, row by row; 1 for two empty ones."""
    a, b = a.to_pylist(), b.to_pylist()
    la, lb = (np.array([len(x) // 8 for x in c], np.int64) for c in (a, b))
    row, tok = distinct(np.concatenate([np.repeat(np.arange(len(a)), la), np.repeat(np.arange(len(b)), lb)]), np.frombuffer(b"".join(a) + b"".join(b), "<u8").astype(_U))
    union = np.bincount(row, minlength=len(a))
    return np.where(union > 0, (la + lb - union) / np.maximum(union, 1), 1.0)


def similar_later(sets: DataFrame, threshold: float) -> DataFrame:
    """(doc, line) of the sets of `sets` (doc, line, n, tokens) that match an earlier one."""
    frequency, records = hashed_frequencies(sets, threshold)
    order, met = Order(frequency, threshold), []
    refuse = max(GROUP, records // 100_000)  # so that the keys refused are at most 100,000 times the expansion of a level
    for level in range(1, LEVELS + 2):
        out = written(_round(sets, order, range(level, level + 1), records, FIRST, refuse if level <= LEVELS else None), "met")
        met.append(out.where("doc is not null"))
        hot = out.where("doc is null").groupBy("doc2").agg(F.sum("c").alias("c")).toArrow() if level <= LEVELS else []
        if not len(hot):
            break
        key, count = hot["doc2"].to_numpy().view(_U), hot["c"].to_numpy()
        at = np.argsort(key)
        order.hot.append((key[at], count[at]))
        records = int(count.sum()) * 4
    close = met[0]
    for m in met[1:]:
        close = close.unionByName(m)
    close = written(close.select("doc", "line", "doc2", "line2").distinct(), "close")
    found = written(_verified(close.where("doc2 is not null"), sets, threshold), "found")
    more = written(close.where("doc2 is null").select("doc", "line").join(_small(found), ["doc", "line"], "left_anti"), "unsettled")
    if more.isEmpty():
        return found
    sets.sparkSession.sparkContext._jvm.System.gc()  # lets the cleaner delete the shuffle files of the first round
    marked = _marks(sets.join(_small(more), ["doc", "line"], "left_semi"), order)
    asked = sets.join(_small(more.withColumn("ask", F.lit(True))), ["doc", "line"], "left").withColumn("ask", F.coalesce("ask", F.lit(False)))
    pairs = written(_round(asked, order, range(1, LEVELS + 2), records, None, None, marked).select("doc", "line", "doc2", "line2").distinct(), "all-candidates")
    return found.unionByName(_verified(pairs, sets, threshold)).distinct()


def keyed(docs: DataFrame, id_col: str) -> DataFrame:
    """`docs` with numbered columns and a unique column doc: the id itself if it is unique, else a number in order of id."""
    own, key = numbered(docs), F.col(f"c{place(docs, id_col)}")
    twice = own.select(key.cast("long").alias("k")).groupBy("k").agg(F.count("*").alias("c")).where("k is null or c > 1")
    if twice.isEmpty():
        return own.withColumn("doc", key.cast("long"))
    text = [F.col(f"c{i}") for i, c in enumerate(docs.columns) if c.lower() == "text"]
    return written(own.orderBy(key.cast("long").asc_nulls_first(), *text).withColumn("doc", F.monotonically_increasing_id()), "keyed")


def removed_sets(lines: DataFrame, threshold: float) -> DataFrame:
    """(doc, line) of the rows of `lines` (see SETS) that repeat or match an earlier set; of rows of one set, one at least has tokens. Deletes `lines`."""
    where, key = F.struct("doc", "line"), ["s0", "s1"]
    bearer = F.min(F.when(F.col("tokens").isNotNull(), where)).alias("b")  # not the first line if its task read a later one before it
    first = lines.groupBy(*key).agg(F.min(where).alias("f"), bearer, F.count("*").alias("c")).where("c > 1").select(*key, F.col("f.doc").alias("fd"), F.col("f.line").alias("fl"), F.col("b.doc").alias("bd"), F.col("b.line").alias("bl"))
    places = lines.select("doc", "line", *key, F.col("tokens").isNotNull().alias("held"))
    bears = F.expr("doc = bd AND line = bl")
    to = [F.when(bears, F.col(c)).alias(c) for c in ("fd", "fl")]
    repeats = written(places.join(written(first, "first-lines"), key).where("doc <> fd or line <> fl").select("doc", "line", "held", *to), "repeats")
    own = lines.where("tokens is not null").select("doc", "line", "n", "tokens").join(_small(repeats.where("held")), ["doc", "line"], "left")
    sets = written(own.where("held is null or fd is not null").select(F.coalesce("fd", "doc").alias("doc"), F.coalesce("fl", "line").alias("line"), "n", "tokens"), "sets")
    discard(lines)
    similar = similar_later(sets, threshold)
    out = written(repeats.select("doc", "line").unionByName(similar).distinct(), "removed-lines")
    discard(sets)
    return out


def removed_lines(docs: DataFrame, text: str, threshold: float = THRESHOLD) -> DataFrame:
    """(doc, line) of the lines to remove of documents with a unique `doc`."""
    return removed_sets(written(docs.select("doc", F.col(text).cast("string").alias("text")).mapInArrow(_line_sets, SETS), "line-sets"), threshold)


def _bounded(removed: DataFrame) -> DataFrame:
    """Broadcast (doc, removed) if rows and arrays together are small."""
    rows, lines = removed.agg(F.count("*"), F.coalesce(F.sum(F.size("removed")), F.lit(0))).first()
    return F.broadcast(removed) if 64 * rows + 4 * lines <= BROADCAST_BYTES else removed


def _deduped(docs: DataFrame, threshold: float, id_col: str, text_col: str) -> DataFrame:
    """Numbered columns of `docs` with the texts of the lines that stay, n_lines (with words) and removed."""
    own, text = keyed(docs, id_col), f"c{place(docs, text_col)}"
    gone = removed_lines(own, text, threshold)
    removed = written(gone.groupBy("doc").agg(F.array_sort(F.collect_list("line")).alias("removed")).withColumnRenamed("doc", "d"), "removed")
    out = own.join(_bounded(removed), F.col("doc") == F.col("d"), "left")
    lines = F.split(F.col(text).cast("string"), "\n", -1)
    kept = F.array_join(F.filter(lines, lambda _, i: ~F.array_contains("removed", i)), "\n")
    n_lines = F.size(F.filter(F.coalesce(lines, F.array().cast("array<string>")), lambda x: F.translate(x, " \t\r\x0b\x0c", "") != ""))
    return out.select(
        *[F.when(F.col("removed").isNull(), F.col(c)).otherwise(kept).alias(c) if c == text else F.col(c) for c in (f"c{i}" for i in range(len(docs.columns)))],
        n_lines.alias("n_lines"),
        F.coalesce("removed", F.array().cast("array<int>")).alias("removed"),
    )


def dedup_lines(docs: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` with the texts of the lines that stay, and columns __n_lines (with words), __removed (line numbers, sorted).

    Documents that lose all lines with words stay here with what is left; `keep_documents` drops them.
    """
    return _deduped(docs, threshold, id_col, text_col).toDF(*docs.columns, "__n_lines", "__removed")


def keep_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` after line dedup, without the documents of which no line with words is left."""
    out = _deduped(docs, THRESHOLD, id_col, text_col)
    return out.where((F.col("n_lines") == 0) | (F.size("removed") < F.col("n_lines"))).drop("n_lines", "removed").toDF(*docs.columns)


def op8_lines(spark, sf_dir):
    out = dedup_lines(pick(table(spark, sf_dir, "documents"), doc_id="doc_id", text="text"))
    return out.select("doc_id", F.col("__n_lines").alias("n_lines"), F.size("__removed").alias("n_removed"), F.array_join(F.transform("__removed", lambda x: x.cast("string")), ",").alias("removed_lines"), "text")
