"""Each operator on odd inputs and against brute force."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from siltstone.llm import chat, common, components, cotrain, decontam, licences, linededup, lm, maxscore, pieces, sharding, simhash, words

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, doc string, line string, uid string, row string, score string, removed string"


@pytest.fixture(scope="module")
def texts():
    """Copies, near copies, nulls, empty and long texts, repeated rows."""
    rng = random.Random(5)
    words = [f"w{i}" for i in range(300)]
    common = ["the", "of", "and", "a"]
    make = lambda n: " ".join(rng.choice(common) if rng.random() < 0.5 else rng.choice(words) for _ in range(n))
    base = ["\n".join(make(rng.randint(3, 25)) for _ in range(rng.randint(1, 8))) for _ in range(60)]
    out = list(enumerate(base))
    for i in range(20):
        t = base[i].split(" ")
        t[rng.randrange(len(t))] = "changed"
        out.append((100 + i, " ".join(t)))
        out.append((200 + i, base[i]))
    out += [(300, None), (301, ""), (302, " \n\t "), (303, make(30_000)), (None, base[3]), (None, None), (5, base[5]), (5, base[5]), (7, "other text with the same id"), (304, "ÄÖ İ ß\x0b\x1c\u00a0\u2028 é😀 " * 5)]
    return out


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, "en" if (i or 0) % 3 else None, f"src{(i or 0) % 2}", len(t) if t else None, *["x"] * 7) for i, t in texts]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def key(r):
    return tuple((x is None, str(x)) for x in r)


# --- language model ------------------------------------------------------------------------------------------------


def lm_rows(docs, **kw):
    own = docs.select("doc_id", "text").withColumn("held_out", lm.held_out(F.col("doc_id")))
    return lm.score(lm.train(own.where("not held_out"), **kw), own).collect()


def test_lm_counts_match_brute_force(docs, texts):
    counts, toks = Counter(), []
    for i, t in texts:
        w = (t or "").encode().lower().split() + [None]
        out = zlib.crc32(str(i).encode() if i is not None else b"") % 5 == 1
        toks.append((i, out, w))
        if not out:
            counts.update(w)
    n, v = sum(counts.values()), len(counts)
    want = sorted(((i, out, len(w), sum(counts[x] > 0 for x in w), n, round(sum(math.log10((counts[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w), 6)) for i, out, w in toks), key=key)
    got = lm_rows(docs)
    assert sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got), key=key) == want
    assert all(math.isfinite(r.score) and r.score < 0 for r in got)
    assert sum(r.score for r in got) > sum(r.base_score for r in got)


def test_lm_segments_and_shuffle_change_nothing(docs):
    a, b, c = (sorted(map(tuple, lm_rows(docs, **kw)), key=key) for kw in ({}, {"segment_bytes": 4000, "most_segments": 1000}, {"segment_bytes": 4000, "most_segments": 0}))
    assert a == b == c


def test_lm_asks_by_few_rows(spark, monkeypatch):
    """A task's texts ask together, one row a part of the key space, however small the buffers of texts are."""
    rng, asked, write = random.Random(5), [], lm.written
    rows = [(i, " ".join(f"w{rng.randrange(3000)}" for _ in range(400))) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    want = sorted(map(tuple, lm_rows(df)))
    monkeypatch.setattr(words, "BUFFER", 5000)
    monkeypatch.setattr(lm, "written", lambda d, name: asked.append(write(d, name)) or asked[-1] if name == "asked" else write(d, name))
    got = sorted(map(tuple, lm_rows(df, segment_bytes=4000, most_segments=0)))
    assert len(asked) == 2 and all(a.count() <= 1 + 2 * (1 << lm.REGION_BITS - lm.PART_BITS) for a in asked)
    assert [r[:-2] for r in got] == [r[:-2] for r in want] and np.allclose([r[-2:] for r in got], [r[-2:] for r in want])


def lm_reference(texts, weights):
    """Scores from dictionaries of exact counts, quantised as the filter's levels, and the sum of P over each context's vocabulary."""
    uni, bi, toks = Counter(), Counter(), []
    for i, t in texts:
        w = ["<start>", *(t or "").encode().lower().split(), "<end>"]
        out = zlib.crc32(str(i).encode() if i is not None else b"") % 5 == 1
        toks.append((i, out, w))
        if not out:
            uni.update(w[1:])
            bi.update(zip(w, w[1:]))
    n, v, n_texts = sum(uni.values()), len(uni), sum(not out for _, out, _ in toks)
    level, middle = lambda c: c.bit_length(), lambda k: 1.5 * 2 ** (k - 1) - 0.5 if k else 0.0
    total = defaultdict(float)
    for (u, _), c in bi.items():
        total[u] += middle(level(c))

    def p(u, w):
        a = weights[level(n_texts if u == "<start>" else uni[u])] if total[u] else 0.0
        return a * (middle(level(bi[u, w])) / total[u] if total[u] else 0.0) + (1 - a) * (uni[w] + 0.5) / (n + 0.5 * (v + 1))

    scores = [(i, out, sum(math.log10(p(*x)) for x in zip(w, w[1:]))) for i, out, w in toks]
    return scores, [sum(p(u, w) for w in [*uni, "<a word not seen>"]) for u in list(total)[:200]]


def test_lm_scores_match_dictionaries(docs, texts):
    own = docs.select("doc_id", "text").withColumn("held_out", lm.held_out(F.col("doc_id")))
    model = lm.train(own.where("not held_out"), bits_per_key=20_000)  # hardly any false positives
    got = sorted(((r.doc_id, r.held_out, r.score) for r in lm.score(model, own).collect()), key=key)
    want, sums = lm_reference(texts, model.weights)
    want.sort(key=key)
    assert [x[:2] for x in got] == [x[:2] for x in want]
    near = [abs(a[2] - b[2]) < 1e-6 * max(1, abs(b[2])) for a, b in zip(got, want)]
    assert np.mean(near) > 0.98
    assert all(x == pytest.approx(1) for x in sums)


def test_lm_filter_levels():
    rng = np.random.default_rng(1)
    keys = np.sort(rng.integers(0, 2**63, 5000).astype(np.uint64))
    counts = rng.integers(1, 100, 5000)
    rows = [r for b in lm._build(lm._by_region(lm.PAIRS, keys, counts, lm._region(keys, 10)), 10) for r in b.to_pylist() if r["kind"] == lm.PAIRS]
    sizes = [dict(r, **{c: len(r[c]) for c in ("blob", "more", "last")}) for r in rows]
    got = lm.Segment(sizes, iter(rows), 10).levels(keys)
    want = lm._level(counts)
    assert (got >= want).all() and (got == want).mean() > 0.95  # never too low, rarely too high
    absent = rng.integers(0, 2**63, 5000).astype(np.uint64)
    assert (lm.Segment(sizes, iter(rows), 10).levels(absent) > 0).mean() < 0.03
    assert (lm._unmix(lm._mix(keys)) == keys).all()


def test_lm_empty(empty):
    assert lm_rows(empty) == []


# --- SimHash -------------------------------------------------------------------------------------------------------


def brute_components(fps, ids, bits):
    parent = list(range(len(fps)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= bits:
                parent[find(i)] = find(j)
    least = defaultdict(list)
    for i in range(len(fps)):
        if ids[i] is not None:
            least[find(i)].append(ids[i])
    return [min(least[find(i)], default=None) for i in range(len(fps))]


def test_simhash_matches_brute_force(docs, texts):
    import xxhash

    def fp(t):
        w = (t or "").encode().lower().split()
        if not w:
            return 0
        h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 4]), 42) for i in range(max(1, len(w) - 3))]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    fps = [fp(t) for _, t in texts]
    want = sorted(zip([i for i, _ in texts], fps, brute_components(fps, [i for i, _ in texts], 4)), key=key)
    got = sorted(((r.id, r.fp & (2**64 - 1), r.component) for r in simhash.near_duplicates(docs).collect()), key=key)
    assert got == want


@pytest.mark.parametrize("bits", [0, 2, 4])
def test_links_of_a_dense_cluster(spark, bits):
    """Many fingerprints within a few bits of each other: the components of all links, from few links."""
    rng = random.Random(bits)
    center = rng.getrandbits(64)
    fps = sorted({center ^ sum(1 << rng.randrange(64) for _ in range(rng.randint(0, 5))) & (2**64 - 1) for _ in range(400)} | {rng.getrandbits(64) for _ in range(200)})
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    links = simhash.near_links(spark.createDataFrame([(f,) for f in signed], "fp long"), bits)
    rows = links.collect()
    assert all(0 < bin((r.u ^ r.v) & (2**64 - 1)).count("1") <= bits for r in rows)
    root = {r.u: r.root for r in components.components(links).collect()}
    got = [root.get(f, f) for f in signed]
    assert got == brute_components(fps, signed, bits)


@pytest.mark.parametrize("segments", [6, 7, 8])
def test_chain_never_loses_a_link(segments):
    rng = np.random.default_rng(2)
    x = np.zeros(2000, np.uint64)
    for _ in range(4):
        x ^= np.uint64(1) << rng.integers(0, 64, 2000).astype(np.uint64)
    assert simhash.chain_holds(x, 4, segments).all()
    assert simhash.chain_holds(rng.integers(0, 2**63, 2000).astype(np.uint64), 4, segments).mean() < 0.01


def test_more_fingerprints_take_more_segments(spark):
    assert [simhash.segments_for(n) for n in (0, 10**5, 10**7, 10**9, 10**11)] == [6, 6, 6, 7, 8]
    rng = random.Random(9)
    fps = sorted({f ^ sum(1 << rng.randrange(62) for _ in range(rng.randint(0, 5))) for f in [rng.getrandbits(62) for _ in range(60)] for _ in range(4)})
    df = spark.createDataFrame([(f,) for f in fps], "fp long")
    for m in (6, 7, 8):
        root = {r.u: r.root for r in components.components(simhash.near_links(df, 4, m)).collect()}
        assert [root.get(f, f) for f in fps] == brute_components(fps, fps, 4)


def edited_copies(rng, n):
    """Texts and copies of them with more and more edits."""
    rows = []
    for i in range(n):
        words = [f"w{rng.randrange(3000)}" for _ in range(rng.randint(60, 300))]
        rows.append((i, " ".join(words)))
        for c, edits in enumerate((1, len(words) // 60, len(words) // 30)):
            for at in rng.sample(range(len(words)), edits):
                words[at] = f"x{rng.randrange(10**9)}"
            rows.append((1000 * (c + 1) + i, " ".join(words)))
    return rows


def similar_pairs(rows, threshold=0.8, width=5):
    """(pairs of the distinct sets, by brute force; the ids of each set; the sets)."""
    ids = defaultdict(list)
    for i, t in rows:
        w = (t or "").encode().lower().split()
        ids[frozenset(tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))) if w else frozenset()].append(i)
    sets = list(ids)
    like = lambda s, o: len(s & o) >= threshold * len(s | o) - 1e-9 if s | o else True
    return [(a, b) for b in range(len(sets)) for a in range(b) if like(sets[a], sets[b])], ids, sets


@pytest.mark.parametrize("group", [simhash.GROUP, 3])
def test_similar_groups(spark, group, monkeypatch):
    """Recall against brute force, no link below the threshold, and blocks of a key that many share."""
    monkeypatch.setattr(simhash, "GROUP", group)
    rows = edited_copies(random.Random(8), 60)
    rows += [(9000 + i, rows[i][1]) for i in range(5)] + [(9100, None), (9101, ""), (9102, "two words"), (9103, "Two words")]
    pairs, ids, sets = similar_pairs(rows)
    got = {r.id: r.component for r in simhash.similar_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    least = [min(ids[s]) for s in sets]
    assert all(got[i] == got[least[k]] for k, s in enumerate(sets) for i in ids[s])  # copies
    assert np.mean([got[least[a]] == got[least[b]] for a, b in pairs]) >= (0.95 if group > 3 else 0.9)
    whole = brute_components_of(len(sets), pairs)
    assert all(whole[a] == whole[b] for a in range(len(sets)) for b in range(a) if got[least[a]] == got[least[b]])
    assert all(got[i] <= i and got[got[i]] == got[i] for i in got)


def test_similar_groups_of_crowded_keys(spark, monkeypatch):
    """Links that fail their check, under keys with many links or too many fingerprints, hide no others."""
    rng = random.Random(3)
    rows = []
    for c in range(4):  # each text differs a little from the one before, and more from those further off
        words = [f"w{rng.randrange(10**6)}" for _ in range(150)]
        for k in range(24):
            rows.append((c * 100 + k, " ".join(words)))
            words[(k * 7) % 150] = f"x{rng.randrange(10**6)}"
            words[(k * 7 + 61) % 150] = f"y{rng.randrange(10**6)}"
    rng.shuffle(rows)
    rows = [(i, t) for i, (_, t) in enumerate(rows)]  # ids in no order of the chain
    df = spark.createDataFrame(rows, "doc_id long, text string")
    groups = lambda: {r.id: r.component for r in simhash.similar_groups(df).collect()}
    want = groups()
    assert len(set(want.values())) == 4
    monkeypatch.setattr(simhash, "ALL_PAIRS", 2)
    monkeypatch.setattr(simhash, "DENSE", 0)
    assert groups() == want
    monkeypatch.setattr(simhash, "GROUP", 3)
    assert groups() == want


def brute_components_of(n, pairs):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        parent[find(a)] = find(b)
    return [find(x) for x in range(n)]


def test_keep_one_similar(docs, texts, empty):
    kept = simhash.keep_one_similar(docs)
    assert kept.columns == docs.columns
    pairs, ids, sets = similar_pairs(texts)
    assert kept.count() == len(set(brute_components_of(len(sets), pairs)))
    assert simhash.keep_one_similar(empty).count() == 0


def test_shingle_sets_and_wide_fingerprints():
    rng = random.Random(1)
    texts = [" ".join(rng.choice(["a", "bb", "a-longer-word", "y" * 70]) for _ in range(rng.randint(0, 12))).encode() for _ in range(50)] + [None, b"", b"\n x\t"]
    group, values = simhash.shingle_sets(texts, 3)
    for i, t in enumerate(texts):
        w = (t or b"").lower().split()
        assert (group == i).sum() == len({tuple(w[k : k + 3]) for k in range(max(1, len(w) - 2))} if w else ())
    fps = simhash.wide_fingerprints(group, values, len(texts))
    for i in range(len(texts)):
        own = values[group == i]
        for k in range(simhash.WIDE):
            h = simhash.mix(own + np.uint64(0x9E3779B97F4A7C15 * (k + 1) & 2**64 - 1))
            want = sum(1 << b for b in range(64) if 2 * sum(int(x) >> b & 1 for x in h) > len(h))
            assert int(fps[i, k]) == want


def test_keep_one(docs, empty):
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    comp = {r.id: r.component for r in simhash.near_duplicates(docs).collect() if r.id is not None}
    assert {r.doc_id for r in kept.where("doc_id is not null").collect()} == {i for i, c in comp.items() if i == c}
    assert simhash.keep_one(empty).count() == 0


def test_components_of_a_long_path(spark):
    edges = spark.range(300).select(F.col("id").alias("u"), (F.col("id") + 1).alias("v"))
    assert {(r.u, r.root) for r in components.components(edges).collect()} == {(i, 0) for i in range(1, 301)}


# --- sharding ------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("limit", [500, 20_000, 10**9])
def test_shards(docs, texts, limit):
    rows = sharding.extendible_shards(docs, limit).collect()
    assert sorted(((r.id, r.bytes) for r in rows), key=key) == sorted(((i, len((t or "").encode())) for i, t in texts), key=key)
    sizes, n = Counter(), Counter()
    for r in rows:
        sizes[r.shard] += r.bytes
        n[r.shard] += 1
    assert all(r.shard_bytes == sizes[r.shard] and r.shard_rows == n[r.shard] and r.depth == len(r.shard) for r in rows)
    assert all(s <= limit or n[k] == 1 for k, s in sizes.items())
    assert all(r.oversized == (sizes[r.shard] > limit) for r in rows)
    # a shard was split from one that was too large, and no shard lies within another
    names = sorted(sizes)
    assert not any(b.startswith(a) and a != b for a, b in zip(names, names[1:]))
    for k in names:
        if k:
            assert sum(s for j, s in sizes.items() if j.startswith(k[:-1])) > limit


def test_shards_of_rows_alike(spark, empty):
    same = spark.createDataFrame([(1, "x" * 100)] * 64, "doc_id long, text string")
    rows = sharding.extendible_shards(same, 450).collect()
    assert len(rows) == 64 and max(Counter(r.shard for r in rows).values()) <= 4
    assert sharding.extendible_shards(empty).count() == 0


def test_write_shards(docs, tmp_path, spark):
    sharding.write_shards(docs, str(tmp_path / "s"), 5000)
    assert spark.read.parquet(str(tmp_path / "s")).count() == docs.count()


# --- licences ------------------------------------------------------------------------------------------------------


def test_licences(spark, docs, empty):
    mit = "Copyright (c) 2020 Somebody\n\n" + licences.TEXTS["MIT"].upper().replace(",", " ,") + "\nAll rights reserved."
    isc = licences.TEXTS["ISC"].replace("software", "software ")
    rows = [(1, mit), (2, "prose\n# Licenced under the Apache Licence, Version 2.0\nmore"), (3, "Released under the MIT License."), (4, None), (5, "the MIT License is good"), (6, isc), (None, "")]
    got = {r.id: (r.licence, r.notices) for r in licences.scan_licences(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: ("MIT", []), 2: (None, ["Apache-2.0"]), 3: (None, ["MIT"]), 4: (None, []), 5: (None, []), 6: ("ISC", []), None: (None, [])}
    assert licences.scan_licences(docs).count() == docs.count()
    assert licences.scan_licences(empty).count() == 0


def test_licences_in_full(spark):
    """Whole texts from files that many systems hold, and a caller's own."""
    import os

    names = {"Apache-2.0": "Apache-2.0", "GPL-3.0": "GPL-3", "GPL-2.0": "GPL-2", "LGPL-3.0": "LGPL-3", "MPL-2.0": "MPL-2.0", "CC0-1.0": "CC0-1.0"}
    there = [(k, open(p, encoding="utf-8").read()) for k, f in names.items() if os.path.exists(p := f"/usr/share/common-licenses/{f}")]
    rows = [(k, t.replace("license", "licence").upper() + "\nCopyright Jane Doe and Others\n") for k, t in there] + [("own", "House  Rules: be kind.")]
    more = spark.createDataFrame([("own", "house rules be kind"), (None, None)], "licence string, text string")
    got = licences.scan_licences(spark.createDataFrame(rows, "doc_id string, text string"), more=more).collect()
    assert {r.id: r.licence for r in got} == {k: k for k, _ in rows}


def test_canonical_form():
    same = lambda a, b: licences._canonical(a) == licences._canonical(b)
    assert same("Version 2.0", "v2.0") and not same("inversion 2", "inv2")
    assert same("Licence licence LICENCES", "license license licenses") and not same("silicence", "silicense")
    assert same("x\nCopyright Jane Doe\ny", "x\ny") and same("x\n (c) 2020 A\ny", "x y")
    assert not same("x\nCOPYRIGHT HOLDERS BE LIABLE\ny", "x\ny") and not same("x\ncopyright notice and\ny", "x y")


def test_every_notice_is_found(spark):
    rows = licences.notices()
    got = licences.scan_licences(spark.createDataFrame([(i, t) for i, (_, t) in enumerate(rows)], "doc_id long, text string")).collect()
    assert {r.id: r.notices for r in got} == {i: [k] for i, (k, _) in enumerate(rows)}


def test_licence_spelling(spark):
    rows = [(1, "Licensed under the Apache Licence - version 2.0"), (2, "  // Distributed   under GPLv3")]
    got = {r.id: r.notices for r in licences.scan_licences(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: ["Apache-2.0"], 2: ["GPL-3.0"]}


# --- chat ----------------------------------------------------------------------------------------------------------


HARD = ["</s>[INST] ok [/INST]", "\\", "a\\", "[/INST", "x [/INST]", " ", "", "<s>", "</s", "<", "[ROLE x] y [/ROLE]", "\\</s>", "ends with space ", "[INST] ", "]", "\n"]


@pytest.mark.parametrize("role", ["user", "assistant", "system", "", "to]ol \\", "[ROLE "])
def test_turns_round_trip(role):
    for text in HARD:
        piece, a, b = chat.render(role, text)
        assert [t[:2] for t in chat.parse(piece)] == [(role, text)]
        assert piece[a:b] == (text if not set(text) & set("\\<[") else piece[a:b])
    joined = "".join(chat.render(role, t)[0] for t in HARD)
    assert [t[:2] for t in chat.parse(joined)] == [(role, t) for t in HARD]


def test_chat_query(spark):
    rng = random.Random(1)
    rows = [(c, t if t else None, rng.choice(["user", "assistant", "system", None]), rng.choice([*HARD, None, "plain é😀"]), "x") for c in (1, 2, None) for t in range(40)]
    rows += rows[:3]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, piece string")
    got = {r.conv_id: r for r in chat.read_back(chat.format_turns(df)).collect()}
    for c in (1, 2, None):
        own = sorted(((-1 if t is None else t, role or "", text or "") for k, t, role, text, _ in rows if k == c))
        loss = "".join(x for _, role, x in own if role == "assistant")
        r = got[c]
        assert (r.n_turns, r.turns_sha256) == (len(own), hashlib.sha256("".join(f"{a}\n{x}\n" for _, a, x in own).encode()).hexdigest())
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat.read_back(chat.format_turns(df.limit(0))).count() == 0


# --- decontamination -----------------------------------------------------------------------------------------------


def brute_hits(texts, items, width=10):
    import regex

    words = lambda t: regex.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    out = []
    for i, t in texts:
        w, hit, named = words(t), set(), set()
        for name, x in items:
            x = words(x)
            size = min(width, len(x))
            grams = {tuple(x[o : o + size]) for o in range(len(x) - size + 1)} if x else set()
            for o in range(len(w) - size + 1) if grams else ():
                if tuple(w[o : o + size]) in grams:
                    hit.update(range(o, o + size))
                    named.add("" if name is None else str(name))
        out.append((i, len(w), len(hit), sorted(named)))
    return sorted(out, key=key)


def test_decontamination(spark, docs, texts, empty):
    t = {i: x for i, x in texts}
    w = t[20].split()
    items = [(1, " ".join(w[5:30])), (2, "the of and a the of and a the of and a"), (3, None), (4, ""), (11, " ".join(w[8:20])), (2, "changed"), (None, "the other text"), (6, "nothing that occurs anywhere at all in these texts zz")]
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("term", F.lit(1))
    got = decontam.contamination(docs, bench)
    assert sorted(((r.id, r.n_words, r.n_hit, r.item_ids) for r in got.collect()), key=key) == brute_hits(texts, items)
    assert decontam.contamination(empty, bench).count() == 0
    none = decontam.contamination(docs, bench.limit(0)).collect()
    assert len(none) == len(texts) and not any(r.n_hit for r in none)


def test_decontamination_without_broadcast(spark, docs, texts, monkeypatch):
    monkeypatch.setattr(decontam, "_small", lambda df, rows=0: df)
    items = [(1, " ".join(texts[20][1].split()[:40]))]
    got = decontam.contamination(docs, spark.createDataFrame(items, "item_id long, text string"))
    assert sorted(((r.id, r.n_words, r.n_hit, r.item_ids) for r in got.collect()), key=key) == brute_hits(texts, items)


def test_proximity(spark):
    item = "one two three four five six seven eight nine ten"
    docs = spark.createDataFrame([(1, item), (2, item.replace("five six", "six five")), (3, item.replace("five", "x y z five"))], "doc_id long, text string")
    vocabulary, terms = decontam.item_terms(spark.createDataFrame([(1, item)], "item_id long, text string"))
    index = decontam.build_index(docs, vocabulary)
    ids = {r.row: r.id for r in index.where("term = -1").collect()}
    found = lambda slop: {ids[r.row] for r in decontam.matches(index, terms, slop=slop).collect()}
    assert found(0) == {1} and found(1) == {1, 2} and found(3) == {1, 2, 3}
    near = {r.id: (r.n_hit, r.item_ids, r.near_ids) for r in decontam.contamination(docs, spark.createDataFrame([(1, item)], "item_id long, text string"), slop=1).collect()}
    assert near == {1: (10, ["1"], ["1"]), 2: (0, [], ["1"]), 3: (0, [], [])}
    left = lambda slop: {r.doc_id for r in decontam.remove_contaminated(docs, spark.createDataFrame([(1, item)], "item_id long, text string"), slop=slop).collect()}
    assert left(0) == {2, 3} and left(1) == {3}


# --- classifier ----------------------------------------------------------------------------------------------------


def test_classifier_held_out(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(500)]
    rows, labels = [], []
    for i in range(900):
        good = rng.random() < 0.8
        text = " ".join(rng.choice(words) + ("" if good else rng.choice(["%%%", "&&&"])) for _ in range(rng.randint(20, 80)))
        rows.append((i, text, "en", "s1" if good else rng.choice(["s1", "s2"]), len(text)))
        labels.append((i, int(good), 0))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    lab = spark.createDataFrame([x for x in labels if x[0] % 3 == 0], "doc_id long, quality int, toxic int")
    own = cotrain.features(df)
    model = cotrain.fit(own, lab)
    got = {r.doc_id: r for r in cotrain.score(own, model).collect()}
    for view, least in (("text_score", 0.97), ("score", 0.97), ("meta_score", 0.75)):
        right = [(got[i][view] >= 0.5) == bool(q) for i, q, _ in labels if i % 3]
        assert np.mean(right) >= least
    # the same in memory, without Spark
    x = cotrain.matrices([t.encode() for _, t, *_ in rows], [m for _, _, *m in rows], cotrain._Buckets())
    x = [m.astype(np.float32) for m in x]
    known = np.arange(len(rows)) % 3 == 0
    apart = np.array([cotrain.xxhash.xxh32_intdigest(str(i), 3) % cotrain.APART == 0 for i in np.flatnonzero(known)])
    plain = cotrain.co_train(tuple(m[known] for m in x), np.array([q for _, q, _ in labels])[known], cotrain.ArrayPool(*[m[~known] for m in x]), apart)
    for name, want in zip(("text_score", "meta_score", "score"), plain.scores(tuple(x))):
        assert all(got[i][name] == pytest.approx(want[i], abs=1e-3) for i in range(len(rows)))


def test_co_training_passes_labels_between_views():
    """One view alone has seen a feature that the other learns from its pseudo-labels."""
    rng = np.random.default_rng(0)
    y = np.array([0, 1] * 20)
    a = (y[:, None] * 2 - 1 + rng.normal(0, 0.3, (40, 1))).astype(np.float32)
    b = rng.normal(0, 1, (40, 2)).astype(np.float32)
    t = np.array([0, 1] * 500)
    pa_ = (t[:, None] * 2 - 1 + rng.normal(0, 0.3, (1000, 1))).astype(np.float32)
    pb = np.c_[t * 2 - 1 + rng.normal(0, 0.5, 1000), rng.normal(0, 1, 1000)].astype(np.float32)
    apart = np.arange(40) % 4 == 0
    alone, together = (cotrain.co_train((a, b), y, cotrain.ArrayPool(pa_, pb), apart, rounds=r, most=100, sure=0.9) for r in (0, 5))
    right = [((cotrain._odds(m.views[1][0], pb) > 0) == (t == 1)).mean() for m in (alone, together)]
    assert right[1] > 0.9 > right[0]


def test_only_sure_rows_are_handed_over():
    """A view that knows nothing hands over nothing; ties go to the first rows, and no row is handed over twice."""
    x = np.array([[3.0], [3.0], [3.0], [-3.0], [0.0], [0.1]], np.float32)
    view = np.array([2.0, 0.0]), (1.0, 0.0)
    none = np.array([0.0, 1.0]), (1.0, 0.0)
    pool = cotrain.ArrayPool(x, x)
    got = pool.surest([view, none], [set(), set()], 2, 2, 0.95)
    assert got[0][0].tolist() == [3, 0, 1] and got[0][1].tolist() == [0, 1, 1] and not len(got[1][0])
    assert pool.surest([view, none], [{0, 3}, set()], 2, 2, 0.95)[0][0].tolist() == [1, 2]


def test_pool_of_a_table(spark):
    """The distributed pool picks what the one in memory picks, ties as well."""
    rng = np.random.default_rng(4)
    a, b = (np.round(rng.normal(0, 1, (300, n)), 1).astype(np.float16) for n in (cotrain.N_TEXT, cotrain.N_META))
    a[100:200], b[100:200] = a[:100], b[:100]
    df = spark.createDataFrame([(i, bytearray(x.tobytes()), bytearray(y.tobytes())) for i, (x, y) in enumerate(zip(a, b))], "uid long, a binary, b binary").repartition(3)
    views = [(np.r_[np.ones(5), np.zeros(n - 5), 0.1], (1.0, 0.0)) for n in (cotrain.N_TEXT, cotrain.N_META)]
    pools = cotrain.ArrayPool(a.astype(np.float32), b.astype(np.float32)), cotrain.FramePool(df)
    one, two = (p.surest(views, [{1, 2}, set()], 17, 9, 0.8) for p in pools)
    for x, y in zip(one, two):
        assert sorted(x[0].tolist()) == sorted(y[0].tolist()) and len(x[0]) == 26
        assert dict(zip(x[0].tolist(), x[1])) == dict(zip(y[0].tolist(), y[1]))


def test_classifier_odd_inputs(spark, docs, empty):
    lab = spark.createDataFrame([(1, 1), (2, 0), (2, 0), (3, None), (None, 1), (4, 1), (6, 0)], "doc_id long, quality int")
    kept = cotrain.keep_good(docs, lab)
    assert kept.columns == docs.columns
    own, none = cotrain.features(docs), cotrain.features(empty)
    assert cotrain.score(own, cotrain.fit(own, lab)).count() == docs.count()
    assert {r.score for r in cotrain.score(own, cotrain.fit(own, lab.limit(0))).collect()} == {1.0}
    assert cotrain.score(none, cotrain.fit(none, lab)).count() == 0


# --- line dedup ----------------------------------------------------------------------------------------------------


def brute_lines(texts, threshold=0.8):
    order = sorted(range(len(texts)), key=lambda k: (texts[k][0] is not None, texts[k][0] or 0, texts[k][1] is not None, texts[k][1] or ""))
    seen, out = [], {}
    for k in order:
        gone = []
        for j, x in enumerate((texts[k][1] or "").encode().lower().split(b"\n")):
            s = frozenset(x.split())
            if s:
                if any(len(s & o) >= threshold * len(s | o) - 1e-9 for o in seen):
                    gone.append(j)
                seen.append(s)
        out[k] = gone
    return out


def lines_got(df):
    return sorted(((r.doc_id, r.text, r["__removed"]) for r in linededup.dedup_lines(df).collect()), key=key)


def lines_want(texts):
    gone = brute_lines(texts)
    return sorted(((i, t if t is None else "\n".join(x for j, x in enumerate(t.split("\n")) if j not in gone[k]), gone[k]) for k, (i, t) in enumerate(texts)), key=key)


def test_line_dedup(docs, texts, empty):
    own = [(i, t) for i, t in texts if i != 303]  # the brute force is slow on the long text
    assert lines_got(docs.where("doc_id is null or doc_id <> 303")) == lines_want(own)
    assert lines_got(empty) == []


def test_line_dedup_of_unique_ids(spark, texts):
    own = [(k, t) for k, (i, t) in enumerate(texts) if i != 303]
    assert lines_got(spark.createDataFrame(own, "doc_id long, text string")) == lines_want(own)


def test_line_dedup_of_rows_out_of_order(spark):
    """A line that its task reads before the first one of the same set, and near matches of both."""
    line, near = " ".join(f"a{i}" for i in range(12)), " ".join(f"a{i}" for i in range(11))
    rows = [(9, line), (3, line), (5, near), (7, near), (1, "x y"), (2, near + " b")]
    for own in (rows, rows[:4]):
        assert lines_got(spark.createDataFrame(own, "doc_id long, text string").coalesce(1)) == lines_want(own)


def test_line_dedup_in_any_order(spark, texts):
    """The same lines go however rows lie in tasks."""
    own = [(k, t) for k, (i, t) in enumerate(texts) if i != 303]
    want = lines_want(own)
    for seed, parts in ((1, 1), (2, 5)):
        rows = random.Random(seed).sample(own, len(own))
        assert lines_got(spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)) == want


@pytest.mark.parametrize(("group", "first"), [(4096, 8), (20, 2), (3, 1)])
def test_line_dedup_of_many_variants(spark, monkeypatch, group, first):
    """A large family of variants of a line and false candidates: keys of many tokens, blocks, and sets with more candidates than the first round takes."""
    monkeypatch.setattr(linededup, "GROUP", group)
    monkeypatch.setattr(linededup, "FIRST", first)
    rng = random.Random(4)
    core = [f"c{i}" for i in range(20)]
    rows = [(i, " ".join(core[:15] + rng.sample(core[15:] + [f"v{k}" for k in range(12)], rng.randint(3, 6)))) for i in range(150)]
    rows += [(1000 + i, "\n".join(" ".join(rng.choice([f"w{k}" for k in range(40)]) for _ in range(rng.randint(1, 14))) for _ in range(rng.randint(1, 6)))) for i in range(150)]
    rows += [(3000, " ".join(f"z{i}" for i in range(300))), (3001, " ".join(f"z{i}" for i in range(290))), (3002, "a" * 99 + " b"), (3003, "a" * 99 + " b c")]
    assert lines_got(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)) == lines_want(rows)


def test_words_of_many_texts():
    texts = [b" a  Bb\n\x0bccc ", None, b"", b"x" * 100 + b"\n" + b"y" * 64 + b" " + b"z" * 65, "é ÄB\u00a0c\u2028 d".encode(), b"\n\n a"]
    h, text, line, lines = words.word_hashes(texts)
    want = [(i, k, w) for i, t in enumerate(texts) for k, row in enumerate((t or b"").lower().split(b"\n")) for w in row.split()]
    assert list(zip(text.tolist(), line.tolist())) == [x[:2] for x in want] and lines.tolist() == [(t or b"").count(b"\n") + 1 for t in texts]
    assert len(set(h.tolist())) == len({x[2] for x in want})
    again = words.word_hashes([w for _, _, w in want])[0]
    assert again.tolist() == h.tolist()


def test_keep_documents(spark):
    rows = [(1, "a b c\nd e f"), (2, "d e f\na b c"), (3, ""), (4, None), (5, "a b c\nnew line here")]
    got = linededup.keep_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, got), key=key) == [(1, "a b c\nd e f"), (3, ""), (4, None), (5, "new line here")]


# --- SentencePiece -------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def transducer():
    return pieces.load()


def test_pieces_match_library(transducer):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    rng = random.Random(6)
    letters = list("abcdefgh the and ing  \n\t.,0123456789éßñ漢字😀ЖAZ\r\\<>")
    words = [p.replace("▁", " ") for p in transducer.ids if len(p) < 8]
    for _ in range(3000):
        text = "".join(rng.choice(letters if rng.random() < 0.5 else words) for _ in range(rng.randint(0, 20)))
        ids = transducer.encode(text)
        assert ids == sp.encode(text)
        assert transducer.decode(ids) == text


def test_literal_space_sign_round_trips(transducer):
    for text in ("▁", "a▁ b", "▁▁x ", " ▁"):
        assert transducer.decode(transducer.encode(text)) == text


def test_unigram_shortest_path():
    """A small unigram model against all segmentations."""
    import itertools
    import struct

    def field(n, data):
        return bytes([n << 3 | 2, len(data)]) + data

    rng = random.Random(7)
    own = {"".join(p): -rng.uniform(1, 5) for n in (1, 2, 3) for p in itertools.product("ab▁", repeat=n) if n == 1 or rng.random() < 0.5}
    own = {k: v for k, v in own.items() if "▁" not in k[1:]}
    piece = lambda t, s, k: field(1, field(1, t.encode()) + b"\x15" + struct.pack("<f", s) + bytes([0x18, k]))
    data = b"".join(piece(f"<0x{b:02X}>", 0, pieces.BYTE) for b in range(256)) + b"".join(piece(t, s, pieces.NORMAL) for t, s in own.items())
    data += field(2, b"\x18\x01" + b"\x98\x02\x01") + field(3, b"\x18\x01\x20\x00\x28\x01")
    t = pieces.Transducer(data)
    assert t.kind == pieces.UNIGRAM

    def best(s):
        return min((min(-own[s[:i]] + best(s[i:]) for i in range(1, len(s) + 1) if s[:i] in own) if s else 0.0,))

    for _ in range(200):
        text = "".join(rng.choice("ab ") for _ in range(rng.randint(1, 8)))
        got = t.shortest("▁" + text.replace(" ", "▁"))
        assert sum(-own[t.text[p]] for p in got) == pytest.approx(best("▁" + text.replace(" ", "▁")), abs=1e-4)
        assert t.decode(t.encode(text)) == text


def test_encode_and_decode_rows(docs, texts, empty, transducer):
    got = pieces.encode(docs, transducer)
    rows = got.collect()
    assert all(r.exact == (r.ids is not None) for r in rows)
    back = sorted((tuple(r) for r in pieces.decode(got, transducer).collect()), key=key)
    assert back == sorted(texts, key=key)
    assert pieces.encode(empty, transducer).count() == 0


# --- top-k ---------------------------------------------------------------------------------------------------------


def brute_topk(rows, every, k):
    own = [(u, i, [math.floor(64 * x) for x in v]) for u, (i, v) in enumerate(rows) if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for u, i, q in own:
        if i is not None and i % every == 0:
            scored = sorted(((-sum(a * b for a, b in zip(q, v)), j if j is not None else 1 << 62, w) for w, j, v in own if w != u))
            out += [(i, r + 1, None if j == 1 << 62 else j, -s) for r, (s, j, _) in enumerate(scored[:k])]
    return sorted(out, key=key)


def test_topk(spark, monkeypatch):
    rng = random.Random(8)
    rows = [(i, [rng.choice([0.0, 0.1, -0.25, rng.gauss(0, 0.3)]) for _ in range(12)]) for i in range(400)]
    rows += [(5, rows[5][1]), (20, rows[20][1]), (20, rows[20][1]), (None, rows[3][1]), (401, None), (402, [None] * 12), (403, [float("nan")] * 12), (404, [float("inf")] * 12), (405, []), (406, [0.5] * 5), (420, [0.5] * 15)]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<double>, score int").coalesce(1)
    run = lambda **kw: sorted(map(tuple, maxscore.exact_topk(df.repartition(3), F.col("vec_id") % 20 == 0, k=7, scale=64.0, **kw).collect()), key=key)
    want = brute_topk(rows, 20, 7)
    monkeypatch.setattr(maxscore, "CHUNK", 50)
    assert run() == want
    assert run(query_block=4) == want
    few = df.limit(3)
    assert len(maxscore.exact_topk(few, F.col("vec_id") == 0, k=7, scale=64.0).collect()) == 2
    assert maxscore.exact_topk(df.limit(0), F.col("vec_id") == 0, k=7, scale=64.0).count() == 0


def test_topk_overflow_is_stated(spark):
    """Scores are exact up to 64 bits: large components that fit give the exact product."""
    big = 2.0**24
    df = spark.createDataFrame([(0, [big, -big]), (1, [big, big]), (2, [-big, big])], "vec_id long, embedding array<double>")
    got = {(r.query_id, r.vec_id): r.score for r in maxscore.exact_topk(df, F.col("vec_id") == 0, k=3, scale=64.0).collect()}
    assert got == {(0, 1): 0, (0, 2): -(2**61)}


# --- names and folders ---------------------------------------------------------------------------------------------


def test_columns_that_clash_by_case(spark):
    """Extra columns whose names differ from ours in case alone, or are names of our own columns."""
    names = ["DOC_ID", "doc_id", "Text", "text", "lang", "source", "n_chars", "c0", "c1", "doc", "__doc", "__n_lines", "removed", "gone", "id", "row", "salt", "component"]
    rows = [["x", i, "y", t, "en", "s", 9, *["z"] * 11] for i, t in enumerate(["a b c d e f g h i j k\nsecond line", "a b c d e f g h i j k", None, "", "two words"])]
    df = spark.createDataFrame([tuple(r) for r in rows], [f"n{i}" for i in range(len(names))]).toDF(*names)
    bench = spark.createDataFrame([(1, "a b c d e f g h i j", "x", "y")], "n long, t string, i string, x string").toDF("item_id", "text", "ITEM_ID", "TEXT")
    labels = spark.createDataFrame([(0, 1, 5), (1, 0, 6)], "d long, q int, x int").toDF("doc_id", "quality", "QUALITY")
    assert simhash.near_duplicates(df).count() == 5
    assert simhash.similar_groups(df).count() == 5
    assert sharding.extendible_shards(df).count() == 5
    assert licences.scan_licences(df).count() == 5
    assert [r.n_hit for r in decontam.contamination(df, bench).orderBy("id").collect()] == [10, 10, 0, 0, 0]
    for kept in (simhash.keep_one(df), simhash.keep_one_similar(df), decontam.remove_contaminated(df, bench), cotrain.keep_good(df, labels), linededup.keep_documents(df)):
        assert kept.columns == names and 0 < kept.count() <= 5
    assert linededup.dedup_lines(df).columns == [*names, "__n_lines", "__removed"]
    assert pieces.encode(df, pieces.load()).count() == 5
    turns = spark.createDataFrame([(1, 0, "user", "hi", "x", "y")], "a long, b long, c string, d string, e string, f string").toDF("conv_id", "turn", "role", "text", "ROLE", "piece")
    assert chat.read_back(chat.format_turns(turns)).first().n_turns == 1
    vectors = spark.createDataFrame([(0, [1.0], "x"), (1, [2.0], "y")], "a long, b array<double>, c string").toDF("vec_id", "embedding", "VEC_ID")
    assert maxscore.exact_topk(vectors, F.col("vec_id") == 0, k=3, scale=64.0).count() == 1
    with pytest.raises(ValueError, match="columns are named"):
        common.place(df.toDF(*["text"] * 2, *names[2:]), "TEXT")


def test_scratch_is_deleted(spark):
    import os

    folder = common.shared_dir(spark).removeprefix("file:")
    before = set(os.listdir(f"{folder}/siltstone"))
    with common.scratch(spark):
        common.written(spark.range(3), "one")
        two = common.written(spark.range(3), "two")
        common.discard(two)
        assert len(set(os.listdir(f"{folder}/siltstone")) - before) == 1
    assert set(os.listdir(f"{folder}/siltstone")) == before
