"""SimHash near-duplicates with pigeonring filtering.

A fingerprint is cut into a ring of segments. If two fingerprints differ in at most t bits, then by the pigeonring
principle some start exists from which every chain of l consecutive segments differs in at most l * t / segments
bits. Candidates are walked chain by chain and dropped as soon as no start is left, before the full Hamming check.

Two forms:

`near_duplicates`: 64-bit fingerprints of word shingles, linked at up to `MAX_BITS` bits, exactly. Of m segments
m - MAX_BITS at least are equal, so these are the keys that find candidates; m grows with the number of fingerprints
(6, 7, 8, ..), so that fingerprints meet by chance only a few at a time.

`similar_groups`: texts whose word shingles have a Jaccard similarity of `jaccard` or more. 64 bits cannot tell these
apart from others (at 0.8 a pair differs in 15 % of its bits), so fingerprints have 256 bits, link at up to 56, and
are found by keys of sampled bits: enough keys that a pair at the threshold meets with probability `RECALL`,
more similar ones with a higher one. Links are then checked on the shingle sets themselves, so that no pair below the
threshold counts; links inside a group that is connected already need no check.

Copies are reduced to distinct fingerprints or shingle sets first. In `near_duplicates` the links within a key are found
by a search from each fingerprint to those not yet reached, and only a spanning forest is kept: as many links as
fingerprints at most, and no connection lost, since every link counts.

In `similar_groups` a link counts only once its sets are checked, so a forest is a first step there. A key has all of its
links given, unless it is crowded: there are more than `DENSE` links a fingerprint, or more than `GROUP` fingerprints,
which are then dealt out in random blocks. Crowded keys give a forest first; what its checked links connect is one group
from there on, and then every link between different groups under these keys is found (a key too large for one task by
all pairs of its blocks) and checked. So the fingerprints that share a key are all compared, however many they are.

A null or empty text has no words: fingerprint 0, the empty set, linked like any other. A null id is kept; a component
of null ids alone has a null id. Repeated rows give repeated results. Extra columns are ignored. No rows: no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import meeting
from .common import discard, pick, place, table, without, written
from .components import components
from .linededup import jaccard, keyed, set_keys
from .words import buffers, distinct, mix, word_hashes

SEED = 42
SEGMENTS = 6  # at least
MAX_BITS = 4
SHINGLE = 4

WIDE, WIDE_BITS = 4, 56  # words of 64 bits in a ring of 16-bit segments; bits that may differ (of a pair at 0.8, 39 do on average, 6 the deviation)
SIMILAR, NEAR_WORDS = 0.8, 5
RECALL = 0.99
MEET = 32  # fingerprints that share a key by chance, about
ALL_PAIRS = 32  # fingerprints of a key whose pairs are taken together with those of others
DENSE = 16  # links a fingerprint beyond which a key is crowded
GROUP = 8192

_U = np.uint64


@cache
def _masks(segments: int) -> list[int]:
    edge = [round(i * 64 / segments) for i in range(segments + 1)]
    return [((1 << (b - a)) - 1) << a for a, b in zip(edge, edge[1:])]


def shingles(text: bytes | None, width: int = SHINGLE) -> np.ndarray:
    """XXH64 values of the word shingles in order; a shorter text is one shingle, one without words has none."""
    words = (text or b"").lower().split()
    if not words:
        return np.zeros(0, _U)
    joined = b" ".join(words)
    if len(words) < width:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], _U)
    ends = list(accumulate(len(w) + 1 for w in words))
    starts = [0, *ends]
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a : b - 1], SEED) for a, b in zip(starts, ends[width - 1 :])], _U)


def fingerprint(text: bytes | None, width: int = SHINGLE) -> int:
    """SimHash of the word shingles, as an unsigned integer."""
    h = shingles(text, width)
    if not len(h):
        return 0
    ones = np.zeros(64, np.int64)
    for i in range(0, len(h), 4096):
        ones += np.unpackbits(h[i : i + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * ones > len(h), bitorder="little")
    return int(bits.view(_U)[0])


def fingerprints(docs: DataFrame, width: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp) for each row; fp is the fingerprint as a signed long."""
    own = pick(docs, id=id_col, text=text_col)
    kind = own.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.fromiter((fingerprint(t, width) for t in batch["text"].cast(pa.binary()).to_pylist()), _U, batch.num_rows)
            yield pa.record_batch([batch["id"], pa.array(fp.view(np.int64))], names=["id", "fp"])

    return own.select("id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"id {kind}, fp long")


def walk(b: np.ndarray, most: int) -> np.ndarray:
    """Rows of `b` (differing bits by segment) with a start from which all chains keep to their share of `most`."""
    n, m = b.shape
    rows, run, out = np.arange(n), b, np.zeros(n, bool)
    alive = run * m <= most
    for length in range(2, m + 1):
        keep = alive.any(axis=1)
        if not keep.all():
            rows, run, alive, b = rows[keep], run[keep], alive[keep], b[keep]
        if not len(rows):
            return out
        run = run + np.roll(b, 1 - length, axis=1)
        alive &= run * m <= most * length
    out[rows[alive.any(axis=1)]] = True
    return out


def chain_holds(x: np.ndarray, max_bits: int = MAX_BITS, segments: int = SEGMENTS) -> np.ndarray:
    """Whether from some start all chains of segments of the difference `x` keep to their budgets."""
    return walk(np.stack([np.bitwise_count(x & _U(m)) for m in _masks(segments)], axis=1).astype(np.int16), max_bits)


def _near(a: np.ndarray, b: np.ndarray | np.uint64, max_bits: int, segments: int = SEGMENTS) -> np.ndarray:
    """Indices where a and b link: the chains first, then all bits."""
    x = a ^ b
    at = np.flatnonzero(chain_holds(x, max_bits, segments))
    return at[np.bitwise_count(x[at]) <= max_bits]


def forest(n: int, near) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (a, b) of a spanning forest over 0..n-1; near(i, rest) gives the places in `rest` that link to i."""
    out, left = [], np.arange(n)
    while len(left) > 1:
        front, left = [int(left[0])], left[1:]
        while front and len(left):
            i = front.pop()
            at = near(i, left)
            if len(at):
                got = left[at]
                out.append((np.full(len(got), i), got))
                front.extend(got.tolist())
                left = np.delete(left, at)
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*out))


def _links(batches: Iterator[pa.RecordBatch], max_bits: int, segments: int) -> Iterator[pa.RecordBatch]:
    """Links within each key of rows sorted by (k, key); a group may span batches."""

    def out(a, b):
        return pa.record_batch([pa.array(np.concatenate(a).view(np.int64)), pa.array(np.concatenate(b).view(np.int64))], names=["u", "v"])

    held: tuple[np.ndarray, ...] = (np.zeros(0, np.int64),) * 3
    done = False
    while not done:
        batch = next(batches, None)
        done = batch is None
        k, key, fp = held if done else (np.concatenate([h, batch[c].to_numpy()]) for h, c in zip(held, ("k", "key", "fp")))
        if not len(k):
            continue
        new = (np.diff(k) != 0) | (np.diff(key) != 0)
        edge = np.r_[0, np.flatnonzero(new) + 1, len(k)]
        if not done:  # the last group may go on
            held, edge = tuple(x[edge[-2] :] for x in (k, key, fp)), edge[:-1]
        size = np.diff(edge)
        a, b = [], []
        two = edge[:-1][size == 2]
        if len(two):
            x, y = fp[two].view(_U), fp[two + 1].view(_U)
            at = _near(x, y, max_bits, segments)
            a.append(x[at])
            b.append(y[at])
        for i in np.flatnonzero(size > 2):
            own = fp[edge[i] : edge[i + 1]].view(_U)
            x, y = forest(len(own), lambda j, rest, own=own: _near(own[rest], own[j], max_bits, segments))
            a.append(own[x])
            b.append(own[y])
        if a and sum(map(len, a)):
            yield out(a, b)


def segments_for(n: int) -> int:
    """Segments of the ring for n distinct fingerprints: equal ones hold log2(n) bits but for five."""
    m = SEGMENTS
    while 64 * (m - MAX_BITS) / m < math.log2(max(2, n)) - 5:
        m += 1
    return m


def near_links(distinct_fps: DataFrame, max_bits: int = MAX_BITS, segments: int | None = None) -> DataFrame:
    """(u, v): links of at most `max_bits` bits that connect what all such links connect. `distinct_fps` has fp, without repeats."""
    if not 0 <= max_bits <= MAX_BITS:
        raise ValueError(f"the chain keys hold up to {MAX_BITS} bits")
    m = segments or segments_for(distinct_fps.count())
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    keys = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col("fp").bitwiseAND(F.lit(signed(sum(own)))).alias("key")) for k, own in enumerate(combinations(_masks(m), m - MAX_BITS))])).alias("e")
    rows = distinct_fps.select("fp", keys).select(F.col("e.k").alias("k"), F.col("e.key").alias("key"), "fp").repartition("k", "key").sortWithinPartitions("k", "key", "fp")
    return rows.mapInArrow(lambda batches: _links(batches, max_bits, m), "u long, v long")


def near_duplicates(docs: DataFrame, width: int = SHINGLE, max_bits: int = MAX_BITS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp, component) for each row of `docs`; component is the least id that links reach."""
    fps = written(fingerprints(docs, width, id_col, text_col), "fingerprints")
    nodes = written(fps.groupBy("fp").agg(F.min("id").alias("least")), "nodes")
    roots = components(near_links(nodes.select("fp"), max_bits))
    rooted = written(nodes.join(roots, nodes.fp == roots.u, "left").select("fp", "least", F.coalesce("root", "fp").alias("root")), "rooted")
    least = rooted.groupBy("root").agg(F.min("least").alias("component"))
    return fps.join(rooted.join(least, "root").select("fp", "component"), "fp").select("id", "fp", "component")


def op2_simhash(spark, sf_dir):
    out = near_duplicates(table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


def keep_one(docs: DataFrame, width: int = SHINGLE, max_bits: int = MAX_BITS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` with one document of each component: that of the least id. Rows without an id are kept."""
    return without(docs, id_col, near_duplicates(docs, width, max_bits, id_col, text_col).where("id <> component").select("id").distinct())


# --- similarity of shingle sets ------------------------------------------------------------------------------------

_NODE = np.dtype([("key", "<u8"), ("node", "<i8")] + [(f"f{k}", "<u8") for k in range(WIDE)])
_FPS = [f"f{k}" for k in range(WIDE)]
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.float32)


def shingle_sets(texts: list[bytes | None], width: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of the distinct word shingles of each text, sorted by text; fewer words than `width` are one shingle."""
    h, text, _, _ = word_hashes(texts)
    n = np.bincount(text, minlength=len(texts))
    end = np.cumsum(n)[text] if len(h) else np.zeros(0, np.int64)
    at = np.arange(len(h))
    first = np.r_[True, text[1:] != text[:-1]] if len(h) else np.zeros(0, bool)
    at = at[(at + width <= end) | (first & (n[text] < width))]
    x = np.zeros(len(at), _U)
    for k in range(width):
        inside = at + k < end[at]
        x = np.where(inside, mix(x * _U(3) + h[np.minimum(at + k, max(0, len(h) - 1))]), x)
    return distinct(text[at], x)


def wide_fingerprints(group: np.ndarray, values: np.ndarray, n_groups: int) -> np.ndarray:
    """(n_groups, WIDE) words: a bit is 1 if it is set in over half the values of a group."""
    size = 8 * WIDE
    out = np.zeros((n_groups, WIDE), _U)
    edge = np.searchsorted(group, np.arange(n_groups + 1))
    a = 0
    while a < n_groups:  # groups of bounded size together
        b = max(a + 1, min(a + 256, int(np.searchsorted(edge, edge[a] + (1 << 17), side="right")) - 1))
        counts = np.zeros(((b - a) * size, 256), np.int64)
        for i in range(edge[a], edge[b], 1 << 17):
            v = values[i : min(edge[b], i + (1 << 17))]
            words = np.stack([mix(v + _U(0x9E3779B97F4A7C15 * (k + 1) & (1 << 64) - 1)) for k in range(WIDE)], axis=1)
            place_ = ((group[i : i + len(v)] - a)[:, None] * size + np.arange(size)) * 256 + words.view(np.uint8)
            counts += np.bincount(place_.ravel(), minlength=counts.size).reshape(counts.shape)
        ones = (counts.astype(np.float32) @ _BITS).reshape(b - a, 64 * WIDE)
        out[a:b] = np.packbits(2 * ones > np.diff(edge[a : b + 1])[:, None], axis=1, bitorder="little").view(_U)
        a = b
    return out


def _sets_and_fingerprints(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        docs, texts = batch["doc"].to_numpy(), batch["text"].cast(pa.binary()).to_pylist()
        for i, j in buffers(texts):
            group, values = shingle_sets(texts[i:j], width)
            fps = wide_fingerprints(group, values, j - i)
            n = np.bincount(group, minlength=j - i)
            s = np.zeros((2, j - i), np.int64)
            some = np.flatnonzero(n)
            if len(some):
                s[:, some] = set_keys(values, n[some], (np.cumsum(n) - n)[some])
            yield pa.record_batch([pa.array(docs[i:j]), pa.array(s[0]), pa.array(s[1]), *[pa.array(fps[:, k].view(np.int64)) for k in range(WIDE)]], names=["doc", "s0", "s1", *_FPS])


def key_plan(nodes: int, jaccard_: float = SIMILAR) -> tuple[int, int]:
    """(bits of a key, keys): about MEET of the nodes share a key by chance, and a pair at the threshold shares one with probability RECALL."""
    bits = max(8, math.ceil(math.log2(max(1, nodes) / MEET)) if nodes > MEET else 8)
    equal = 1 - math.acos(2 * jaccard_ / (1 + jaccard_)) / math.pi
    return bits, math.ceil(-math.log(1 - RECALL) / equal**bits)


def _key_masks(bits: int, keys: int) -> np.ndarray:
    """(keys, WIDE) words with `bits` random bits set, the same in every run."""
    rng = np.random.default_rng(SEED)
    on = np.zeros((keys, 64 * WIDE), np.uint8)
    for row in on:
        row[rng.choice(64 * WIDE, bits, replace=False)] = 1
    return np.packbits(on, axis=1, bitorder="little").view(_U)


def _wide_near(rows: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Which of the pairs (i, j) of rows link: the chains first, then all bits."""
    x = rows[i] ^ rows[j]
    b = np.bitwise_count(x.view(np.uint16)).astype(np.int16)
    at = np.flatnonzero(walk(b, WIDE_BITS))
    return at[b[at].sum(axis=1) <= WIDE_BITS]


def _some_pairs(own: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray] | None:
    """All pairs (a, b) of `own` that link; None if these are more than `most`."""
    out, n = [(np.zeros(0, np.int64),) * 2], 0
    for i in range(len(own) - 1):
        rest = np.arange(i + 1, len(own))
        got = rest[_wide_near(own, np.full(len(rest), i), rest)]
        if len(got):
            out.append((np.full(len(got), i), got))
            n += len(got)
            if n > most:
                return None
    return tuple(np.concatenate(x) for x in zip(*out))


def _linked(u: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
    return pa.record_batch([pa.array(np.minimum(u, v)), pa.array(np.maximum(u, v)), pa.nulls(len(u), pa.int64())], names=["u", "v", "c"])


def _wide_links(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
    """All links within each key; of a crowded one a spanning forest, its key and its count."""
    rows = rows[np.lexsort((rows["node"], rows["key"]))]
    fps, node, key = np.stack([rows[f] for f in _FPS], axis=1), rows["node"], rows["key"]
    edge = np.flatnonzero(np.r_[True, key[1:] != key[:-1], True])
    size = np.diff(edge)
    a, b = [], []
    small = np.repeat(size <= ALL_PAIRS, size)
    left = np.repeat(edge[1:], size) - np.arange(len(rows)) - 1
    at, step = np.flatnonzero(small & (left > 0)), 1
    while len(at):
        for c in range(0, len(at), 1 << 17):
            i = at[c : c + (1 << 17)]
            near = i[_wide_near(fps, i, i + step)]
            a.append(near)
            b.append(near + step)
        step += 1
        at = at[left[at] >= step]
    crowded = []
    for g in np.flatnonzero(size > ALL_PAIRS).tolist():
        first = edge[g]
        own = fps[first : edge[g + 1]]
        got = _some_pairs(own, DENSE * len(own))
        if got is None:
            crowded.append(g)
            got = forest(len(own), lambda i, rest, own=own: _wide_near(own, np.full(len(rest), i), rest))
        a.append(first + got[0])
        b.append(first + got[1])
    if crowded:
        yield _refused(key[edge[:-1][crowded]], size[crowded])
    u, v = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (a, b))
    if len(u):
        yield _linked(node[u], node[v])


def _refused(key: np.ndarray, count: np.ndarray) -> pa.RecordBatch:
    return pa.record_batch([pa.array(key.view(np.int64)), pa.nulls(len(key), pa.int64()), pa.array(count)], names=["u", "v", "c"])


def _wide_round(nodes: DataFrame, masks: np.ndarray, only: np.ndarray | None, blocks: np.ndarray | None, seed: int, records: int) -> DataFrame:
    """Links (u, v) of `nodes` under all keys or `only` these (sorted); keys that too many share are refused (u, c), or with `blocks` dealt out in as many random ones."""
    spark = nodes.sparkSession
    held, n_parts, group = spark.sparkContext.broadcast((masks, only, blocks)), meeting.parts(spark, records), GROUP

    def records_(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        masks, only, blocks = held.value
        node, fps = batch["node"].to_numpy(), [batch[f].to_numpy().view(_U) for f in _FPS]
        for t, mask in enumerate(masks):
            key, at = np.full(len(node), t, _U), np.arange(len(node))
            for f, m in zip(fps, mask):
                key = mix(key * _U(3) + (f & m))
            if only is not None:
                spot = np.minimum(np.searchsorted(only, key), len(only) - 1)
                at = np.flatnonzero(only[spot] == key)
                key = key[at]
                if blocks is not None:
                    key = mix(key + _U(0x9E3779B97F4A7C15) * (mix(node[at].astype(_U) + _U(seed)) % blocks[spot[at]].astype(_U) + _U(1)))
            rows = np.empty(len(at), _NODE)
            rows["key"], rows["node"] = key, node[at]
            for name, f in zip(_FPS, fps):
                rows[name] = f[at]
            yield rows

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from meeting.pack((rows for batch in batches for rows in records_(batch)), n_parts)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from meeting.meet(batches, _NODE, group if blocks is None else None, _wide_links, _refused)

    return written(meeting.deal(nodes.select("node", *_FPS).mapInArrow(send, meeting.SENT)).mapInArrow(meet, "u long, v long, c long"), "wide-links")


def wide_links(nodes: DataFrame, jaccard_: float = SIMILAR) -> tuple[DataFrame, np.ndarray, tuple[np.ndarray, np.ndarray]]:
    """Links (u, v) of nodes (node, f0..) whose fingerprints differ in at most WIDE_BITS bits, u < v; the masks; the crowded keys and their counts.

    All links of keys that are not crowded, some of the others: `_apart` finds the rest of these.
    """
    n = nodes.count()
    plan = key_plan(n, jaccard_)
    masks, records = _key_masks(*plan), n * plan[1]
    every, only, most, seed, crowded = [], None, None, 0, None
    while True:
        out = _wide_round(nodes, masks, only, None, seed, records)
        every.append(out.where("v is not null").select("u", "v"))
        got = out.where("v is null").groupBy("u").agg(F.sum("c").alias("c")).toArrow()
        key, count = got["u"].to_numpy().view(_U), got["c"].to_numpy()
        order = np.argsort(key)
        key, count = key[order], count[order]
        if crowded is None:
            crowded = key, count
        key, count = key[count > GROUP], count[count > GROUP]  # refused
        records = int(count.sum())
        if not records or most is not None and records > 0.9 * most:
            break
        only, most, seed = key, records, seed + 1
        out = _wide_round(nodes, masks, only, -(-count // GROUP), seed, records)
        linked = out.where("v is not null").select("u", "v")
        every.append(linked)
        # for these first links, what the blocks connect goes on as one: nodes with a link to a smaller one stand back
        nodes = written(nodes.join(linked.select(F.col("v").alias("node")).distinct(), "node", "left_anti"), "wide-roots")
    links = every[0]
    for x in every[1:]:
        links = links.unionByName(x)
    return written(links.distinct(), "links"), masks, crowded


_APART = np.dtype([*_NODE.descr, ("root", "<i8"), ("side", "u1")])
_WITHIN = 2  # side of the records of a block that meets itself; 0 and 1 are the lower and the upper block of two


def _apart_links(rows: np.ndarray, nearest: bool) -> Iterator[pa.RecordBatch]:
    """Links within each key between nodes of different roots; of each node all, or the nearest."""
    rows = rows[np.lexsort((rows["node"], rows["root"], rows["side"], rows["key"]))]
    fps, node, root, key, side = np.stack([rows[f] for f in _FPS], axis=1), rows["node"], rows["root"], rows["key"], rows["side"]
    edge = np.flatnonzero(np.r_[True, key[1:] != key[:-1], True]).tolist()
    u, v, held = [], [], 0
    for a, b in zip(edge[:-1], edge[1:]):
        if side[a] == _WITHIN:
            if root[a] == root[b - 1]:
                continue
            run = a + np.searchsorted(root[a:b], root[a:b], side="right")  # where the roots after one's own begin
            meets = ((i, np.arange(run[i - a], b)) for i in range(a, b) if run[i - a] < b)
        else:
            cut = a + int(np.searchsorted(side[a:b], 1))
            few, many = sorted((np.arange(a, cut), np.arange(cut, b)), key=len)
            meets = ((i, many[root[many] != root[i]]) for i in few.tolist())
        for i, rest in meets:
            got = rest[_wide_near(fps, np.full(len(rest), i), rest)]
            if nearest and len(got) > 1:
                got = got[[np.bitwise_count(fps[got] ^ fps[i]).sum(axis=1).argmin()]]
            if len(got):
                u.append(np.full(len(got), node[i]))
                v.append(node[got])
                held += len(got)
                if held >= 1 << 17:
                    yield _linked(np.concatenate(u), np.concatenate(v))
                    u, v, held = [], [], 0
    if held:
        yield _linked(np.concatenate(u), np.concatenate(v))


def _node_keys(fps: list[np.ndarray], masks: np.ndarray, only: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(nodes, their keys, places in `only`) under each mask, of those keys that are in `only`."""
    for t, mask in enumerate(masks):
        key = np.full(len(fps[0]), t, _U)
        for f, m in zip(fps, mask):
            key = mix(key * _U(3) + (f & m))
        spot = np.minimum(np.searchsorted(only, key), len(only) - 1)
        at = np.flatnonzero(only[spot] == key)
        if len(at):
            yield at, key[at], spot[at]


def _large_roots(nodes: DataFrame, masks: np.ndarray, only: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, root, count) of the roots with more than `least` nodes under one of the keys `only`."""
    held = nodes.sparkSession.sparkContext.broadcast((masks, only))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        masks, only = held.value
        for batch in batches:
            root, fps = batch["root"].to_numpy(), [batch[f].to_numpy().view(_U) for f in _FPS]
            for at, key, _ in _node_keys(fps, masks, only):
                yield pa.record_batch([pa.array(key.view(np.int64)), pa.array(root[at])], names=["key", "root"])

    got = nodes.select("root", *_FPS).mapInArrow(run, "key long, root long").groupBy("key", "root").count().where(F.col("count") > least).toArrow()
    return got["key"].to_numpy().view(_U), got["root"].to_numpy(), got["count"].to_numpy()


def _apart(nodes: DataFrame, masks: np.ndarray, crowded: tuple[np.ndarray, np.ndarray], nearest: bool) -> DataFrame:
    """Links (u, v) under the crowded keys between nodes (node, root, f0..) of different roots: all, or the nearest of each node under each key.

    The nodes of a key are dealt out in blocks, each pair of blocks meets. A root lies in one block; one that is too large has several of
    its own, which need not meet each other. So a group that is connected costs what its nodes cost, not what its pairs do.
    """
    spark, half = nodes.sparkSession, max(1, GROUP // 2)
    only, count = crowded
    over = count > GROUP
    large_key, large_root, large_n = _large_roots(nodes, masks, only[over], half // 2) if over.any() else (np.zeros(0, _U), np.zeros(0, np.int64), np.zeros(0, np.int64))
    order = np.lexsort((large_root, large_key))
    large_key, large_root, large_n = large_key[order], large_root[order], large_n[order]
    spot, blocks = np.searchsorted(only, large_key), -(-large_n // half)
    small = np.where(over, np.maximum(1, -(-(count - np.bincount(spot, large_n, len(only)).astype(np.int64)) // half)), 1)
    total = small + np.bincount(spot, blocks, len(only)).astype(np.int64)
    before = np.cumsum(blocks) - blocks  # a key's large roots stand next to each other
    start = small[spot] + before - before[np.searchsorted(spot, spot)] if len(spot) else before
    name = mix(large_key * _U(3) + large_root.astype(_U))
    order = np.argsort(name)
    held = spark.sparkContext.broadcast((masks, only, small, total, name[order], start[order], blocks[order]))
    n_parts = meeting.parts(spark, int((count * total).sum()))
    step = _U(0x9E3779B97F4A7C15)

    def records(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        masks, only, small, total, name, start, blocks = held.value
        node, root, fps = batch["node"].to_numpy(), batch["root"].to_numpy(), [batch[f].to_numpy().view(_U) for f in _FPS]
        for at, key, spot in _node_keys(fps, masks, only):
            block = (mix(root[at].astype(_U)) % small[spot].astype(_U)).astype(np.int64)
            first, last = np.full(len(at), -1), np.full(len(at), -1)  # blocks that need not be met
            if len(name):
                own = mix(key * _U(3) + root[at].astype(_U))
                x = np.minimum(np.searchsorted(name, own), len(name) - 1)
                is_large = name[x] == own
                first, last = np.where(is_large, start[x], -1), np.where(is_large, start[x] + blocks[x], -1)
                block = np.where(is_large, start[x] + (mix(node[at].astype(_U)) % blocks[x].astype(_U)).astype(np.int64), block)
            for other in range(int(total[spot].max())):
                to = np.flatnonzero((other < total[spot]) & ~((first <= other) & (other < last)))
                low, high = np.minimum(block[to], other), np.maximum(block[to], other)
                rows = np.empty(len(to), _APART)
                rows["key"] = mix(mix(key[to] + step * (low + 1).astype(_U)) + step * (high + 1).astype(_U))
                rows["node"], rows["root"] = node[at[to]], root[at[to]]
                rows["side"] = np.where(low == high, _WITHIN, block[to] == high)
                for f_, f in zip(_FPS, fps):
                    rows[f_] = f[at[to]]
                yield rows

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from meeting.pack((rows for batch in batches for rows in records(batch)), n_parts)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from meeting.meet(batches, _APART, None, lambda rows: _apart_links(rows, nearest), _refused)

    out = meeting.deal(nodes.select("node", "root", *_FPS).mapInArrow(send, meeting.SENT)).mapInArrow(meet, "u long, v long, c long")
    return written(out.select("u", "v").distinct(), "apart")


def _checked(links: DataFrame, bodies: DataFrame, jaccard_: float) -> DataFrame:
    """The links whose shingle sets are similar."""
    both = links.join(bodies.toDF("u", "a"), "u").join(bodies.toDF("v", "b"), "v").select("u", "v", "a", "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, 256):
                batch = whole.slice(i, 256)
                at = np.flatnonzero(jaccard(batch["a"], batch["b"]) >= jaccard_ - 1e-9)
                yield pa.record_batch([pa.array(batch["u"].to_numpy()[at]), pa.array(batch["v"].to_numpy()[at])], names=["u", "v"])

    return written(both.mapInArrow(run, "u long, v long"), "checked")


def _bodies(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch["text"].cast(pa.binary()).to_pylist()
        for i, j in buffers(texts):
            group, values = shingle_sets(texts[i:j], width)
            edge, data = (8 * np.searchsorted(group, np.arange(j - i + 1))).tolist(), values.astype("<u8").tobytes()
            yield pa.record_batch([batch["doc"][i:j], pa.array([data[a:b] for a, b in zip(edge[:-1], edge[1:])], pa.binary())], names=["doc", "body"])


def _similar(own: DataFrame, width: int, jaccard_: float) -> DataFrame:
    """(doc, root) of rows (doc, text): root is the least doc of the group."""
    own = own.select("doc", F.col("text").cast("string").alias("text"))
    kinds = "doc long, s0 long, s1 long, " + ", ".join(f"{f} long" for f in _FPS)
    sets = written(own.mapInArrow(lambda b: _sets_and_fingerprints(b, width), kinds), "shingle-sets")
    nodes = written(sets.groupBy("s0", "s1").agg(F.min("doc").alias("node"), *[F.min(f).alias(f) for f in _FPS]), "set-nodes")
    links, masks, crowded = wide_links(nodes.select("node", *_FPS), jaccard_)

    def bodies_of(links: DataFrame) -> DataFrame:
        ends = links.select(F.col("u").alias("doc")).unionByName(links.select(F.col("v").alias("doc"))).distinct()
        return written(own.join(ends, "doc", "left_semi").mapInArrow(lambda b: _bodies(b, width), "doc long, body binary"), "bodies")

    bodies = bodies_of(links)
    # one link a node first; then only those between groups that are not connected yet
    good = _checked(links.groupBy("v").agg(F.min("u").alias("u")).select("u", "v"), bodies, jaccard_)
    root = lambda roots, c: roots.select(F.col("u").alias(c), F.col("root").alias(f"{c}_root"))
    roots = written(components(good), "roots")
    apart = links.join(root(roots, "u"), "u", "left").join(root(roots, "v"), "v", "left").where("coalesce(u_root, u) <> coalesce(v_root, v)").select("u", "v")
    rest = _checked(apart, bodies, jaccard_)
    if not rest.isEmpty():
        good = good.unionByName(rest)
        roots = written(components(good), "roots")
    discard(bodies)
    for nearest in (True, False) if len(crowded[0]) else ():  # the nearest first, so that fewer are left apart
        rooted = written(nodes.join(roots, F.col("node") == F.col("u"), "left").select("node", *_FPS, F.coalesce("root", "node").alias("root")), "rooted")
        apart = _apart(rooted, masks, crowded, nearest)
        if apart.isEmpty():
            break
        bodies = bodies_of(apart)
        rest = _checked(apart, bodies, jaccard_)
        discard(bodies)
        if not rest.isEmpty():
            good = good.unionByName(rest)
            roots = written(components(good), "roots")
    rooted = nodes.join(roots, F.col("node") == F.col("u"), "left").select("s0", "s1", F.coalesce("root", "node").alias("root"))
    return sets.select("doc", "s0", "s1").join(rooted, ["s0", "s1"]).select("doc", "root")


def similar_groups(docs: DataFrame, width: int = NEAR_WORDS, jaccard_: float = SIMILAR, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, component) for each row of `docs`; component is the id of the group's first row (by id, nulls first; repeats by text)."""
    own = keyed(docs, id_col)
    id_, text = f"c{place(docs, id_col)}", f"c{place(docs, text_col)}"
    groups = written(_similar(own.select("doc", F.col(text).alias("text")), width, jaccard_), "groups")
    ids = own.select("doc", F.col(id_).alias("id"))
    return groups.join(ids, "doc").join(ids.toDF("root", "component"), "root").select("id", "component")


def keep_one_similar(docs: DataFrame, width: int = NEAR_WORDS, jaccard_: float = SIMILAR, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` with the first row (by id, nulls first; repeats by text) of each group of similar texts."""
    own = keyed(docs, id_col)
    groups = _similar(own.select("doc", F.col(f"c{place(docs, text_col)}").alias("text")), width, jaccard_)
    gone = written(groups.where("doc <> root").select(F.col("doc").alias("gone")), "similar")
    return own.join(gone, F.col("doc") == F.col("gone"), "left_anti").drop("doc").toDF(*docs.columns)
