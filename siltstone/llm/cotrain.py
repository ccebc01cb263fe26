"""Quality classifier by co-training.

Two views of a document: its text (byte classes, punctuation, word statistics, hashed words) and its metadata
(language, source, stated length). Each view has a logistic classifier. Over `ROUNDS` rounds both are fitted
to their labelled rows and calibrated on labelled rows kept apart; each picks from all unlabelled documents those it
is surest of, good and bad in the labels' proportion and only at a calibrated probability of `SURE` or more, and hands
them with its own label to the other. A view that knows nothing is sure of nothing and hands over nothing. Then the
calibrated log-odds of both are added (less the prior's, counted twice) to score all documents.

Every document's features are computed once, from its whole text, and written as 16-bit numbers (about 700 bytes a
document before compression); rounds and scoring read these. Fitting takes at most `LABELLED` labelled documents, the
first by a hash of their id, and `PICK` rows that a view hands over in a round; only these rows' vectors reach the
driver. Ties in certainty go to the row that comes first.

Labels: nulls are left out; an id with several labels takes their rounded mean. With no labels, or one kind
only, nothing can be told apart and every document gets that kind's share, or 1, as its score. A null text is
empty; null metadata is a value of its own. Null ids and repeated rows are scored like others, each. Missing
metadata columns count as null; extra columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import numbered, pick, place, table, without, written

LABELLED = 10_000
ROUNDS = 5
PICK = 400  # most rows that a view hands over in a round
SURE = 0.95
BROADCAST_ROWS = 1_000_000
APART = 5  # one labelled row in so many is kept apart for calibration
KEEP_AT = 0.5
HASHED = 256
WORDS_HELD = 200_000

_PUNCT = np.array([c for c in range(33, 127) if not chr(c).isalnum()])
N_TEXT = len(_PUNCT) + 6 + 6 + HASHED
N_META = 32 + 64 + 8


class _Buckets(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = h = xxhash.xxh32_intdigest(word, 7) % HASHED
        return h


def text_features(text: bytes | None, buckets: _Buckets) -> np.ndarray:
    """N_TEXT numbers: shares of byte kinds, word and line statistics, hashed word shares."""
    text = text or b""
    out = np.zeros(N_TEXT, np.float32)
    if not text:
        return out
    bytes_ = np.bincount(np.frombuffer(text, np.uint8), minlength=256) / len(text)
    n = len(_PUNCT)
    out[:n] = np.sqrt(bytes_[_PUNCT])
    out[n : n + 6] = bytes_[48:58].sum(), bytes_[65:91].sum(), bytes_[97:123].sum(), bytes_[128:].sum(), bytes_[32], bytes_[10]
    words = text.lower().split()
    if not words:
        return out
    lines = [x for x in text.split(b"\n") if x.strip()]
    at = n + 6
    ids = np.fromiter(map(buckets.__getitem__, words), np.int64, len(words))
    shares = np.bincount(ids, minlength=HASHED) / len(words)
    different = len(set(words))
    out[at : at + 6] = np.log1p(len(words)) / 10, min(100.0, len(text) / len(words) / 20), different / len(words), shares.max(), len(set(lines)) / len(lines), np.log1p(len(words) / len(lines)) / 10
    out[at + 6 :] = np.sqrt(shares)
    if len(buckets) > WORDS_HELD:
        buckets.clear()
    return out


def meta_features(lang: str | None, source: str | None, n_chars: int | None) -> np.ndarray:
    out = np.zeros(N_META, np.float32)
    out[xxhash.xxh32_intdigest(f"l{lang}", 1) % 32] = 1
    out[32 + xxhash.xxh32_intdigest(f"s{source}", 1) % 64] = 1
    size = np.log1p(max(0, n_chars or 0)) / 10
    out[96:] = n_chars is None, size, size * size, *(size > x for x in (0.4, 0.5, 0.6, 0.7, 0.8))
    return out


def _views(docs: DataFrame) -> DataFrame:
    """doc_id, text, lang, source, n_chars; nulls for metadata that `docs` lacks."""
    own, kinds, out = numbered(docs), {"doc_id": "long", "text": "string", "lang": "string", "source": "string", "n_chars": "long"}, []
    for c, kind in kinds.items():
        there = c in ("doc_id", "text") or c.lower() in [x.lower() for x in docs.columns]
        out.append((F.col(f"c{place(docs, c)}") if there else F.lit(None)).cast(kind).alias(c))
    return own.select(*out)


def matrices(texts: list[bytes | None], meta: list[tuple], buckets: _Buckets) -> tuple[np.ndarray, np.ndarray]:
    """Features of both views, as 16-bit numbers."""
    a = [text_features(t, buckets) for t in texts]
    b = [meta_features(*m) for m in meta]
    return np.array(a, np.float16).reshape(-1, N_TEXT), np.array(b, np.float16).reshape(-1, N_META)


def features(docs: DataFrame) -> DataFrame:
    """(uid, doc_id, a, b) of every row, written: a number of its own and the features of both views."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets = _Buckets()
        for whole in batches:
            for i in range(0, whole.num_rows, 1024):
                batch = whole.slice(i, 1024)
                meta = list(zip(*(batch[c].to_pylist() for c in ("lang", "source", "n_chars"))))
                made = matrices(batch["text"].cast(pa.binary()).to_pylist(), meta, buckets)
                yield pa.record_batch([batch["doc_id"], *[pa.array([r.tobytes() for r in m], pa.binary()) for m in made]], names=["doc_id", "a", "b"])

    return written(_views(docs).mapInArrow(run, "doc_id long, a binary, b binary").withColumn("uid", F.monotonically_increasing_id()), "features")


def _stacked(col, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(col.to_pylist()), np.float16).reshape(-1, width).astype(np.float32)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 25) -> np.ndarray:
    """Weights (the last is the intercept) by Newton's method."""
    x = np.c_[x, np.ones(len(x))].astype(np.float64)
    w = np.zeros(x.shape[1])
    penalty = np.full(len(w), ridge)
    penalty[-1] = 1e-3
    for _ in range(steps):
        p = sigmoid(x @ w)
        gradient = x.T @ (p - y) + penalty * w
        hessian = (x * (p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(hessian, gradient)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def _odds(w: np.ndarray, x: np.ndarray) -> np.ndarray:
    return x @ w[:-1].astype(np.float32) + np.float32(w[-1])


class CoTrained:
    """The fitted views: weights, calibration (slope, intercept) and the prior's log-odds."""

    def __init__(self, views: list[tuple[np.ndarray, np.ndarray]] | None, prior: float):
        self.views, self.prior = views, prior

    def scores(self, xs: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text view, metadata view, both): probabilities of good quality."""
        if self.views is None:
            return (np.full(len(xs[0]), self.prior),) * 3
        odds = [a * _odds(w, x) + b for (w, (a, b)), x in zip(self.views, xs)]
        base = np.log(self.prior / (1 - self.prior))
        return sigmoid(odds[0]), sigmoid(odds[1]), sigmoid(odds[0] + odds[1] - base)


def _calibrated(w: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """(slope, intercept) that turn the odds of a view into log-odds of labels it has not seen."""
    slope, intercept = fit_logistic(_odds(w, x)[:, None], y.astype(float), ridge=1e-2)
    return max(0.0, float(slope)), float(intercept)


class ArrayPool:
    """Unlabelled rows in memory."""

    def __init__(self, a: np.ndarray, b: np.ndarray):
        self.x = a, b

    def surest(self, views: list, taken: list[set[int]], good: int, bad: int, sure: float) -> list[tuple[np.ndarray, ...]]:
        """For each view (uids, labels, a, b) of the rows that it is surest of and has not handed over before."""
        out = []
        for v, (w, (slope, intercept)) in enumerate(views):
            p = slope * _odds(w, self.x[v]) + intercept
            bar, uid = np.log(sure / (1 - sure)), np.arange(len(p))
            free = ~np.isin(uid, list(taken[v]))
            up, down = (np.flatnonzero(free & (z >= bar)) for z in (p, -p))
            up, down = up[np.lexsort((up, -p[up]))][:good], down[np.lexsort((down, p[down]))][:bad]
            at = np.r_[down, up]
            out.append((at, np.r_[np.zeros(len(down)), np.ones(len(up))], self.x[0][at], self.x[1][at]))
        return out


class FramePool:
    """All unlabelled rows of a table of features."""

    def __init__(self, rows: DataFrame):
        self.rows = rows

    def surest(self, views: list, taken: list[set[int]], good: int, bad: int, sure: float) -> list[tuple[np.ndarray, ...]]:
        """The same; a task gives at most `good` + `bad` numbers a view, the first of all come from a ranked window."""
        held = self.rows.sparkSession.sparkContext.broadcast((views, [np.array(sorted(t), np.int64) for t in taken]))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            views, taken = held.value
            bar = np.log(sure / (1 - sure))
            best = {(v, y): (np.zeros(0, np.int64), np.zeros(0)) for v in (0, 1) for y in (0, 1)}
            for whole in batches:
                for i in range(0, whole.num_rows, 4096):
                    batch = whole.slice(i, 4096)
                    uid = batch["uid"].to_numpy()
                    for v, (w, (slope, intercept)) in enumerate(views):
                        p = slope * _odds(w, _stacked(batch["ab"[v]], len(w) - 1)) + intercept
                        free = ~np.isin(uid, taken[v])
                        for y, z, most in ((0, -p, bad), (1, p, good)):
                            at = np.flatnonzero(free & (z >= bar))
                            own, score = np.r_[best[v, y][0], uid[at]], np.r_[best[v, y][1], z[at]]
                            order = np.lexsort((own, -score))[:most]
                            best[v, y] = own[order], score[order]
            for (v, y), (own, score) in best.items():
                if len(own):
                    yield pa.record_batch([pa.array(own), pa.array(score), pa.array(np.full(len(own), v, np.int32)), pa.array(np.full(len(own), y, np.int32))], names=["uid", "z", "v", "y"])

        first = Window.partitionBy("v", "y").orderBy(F.desc("z"), "uid")
        tops = self.rows.select("uid", "a", "b").mapInArrow(run, "uid long, z double, v int, y int").withColumn("r", F.row_number().over(first))
        got = tops.where((F.col("r") <= good) & (F.col("y") == 1) | (F.col("r") <= bad) & (F.col("y") == 0)).select("uid", "v", "y", "r").collect()  # at most 2 * (good + bad) rows
        wanted = sorted({r["uid"] for r in got})
        rows = self.rows.where(F.col("uid").isin(wanted)).select("uid", "a", "b").toArrow() if wanted else None
        at = {u: i for i, u in enumerate(rows["uid"].to_pylist())} if rows is not None else {}
        a, b = (_stacked(rows["ab"[v]], n) if rows is not None else np.zeros((0, n), np.float32) for v, n in ((0, N_TEXT), (1, N_META)))
        out = []
        for v in (0, 1):
            own = sorted((r["y"], r["r"], r["uid"]) for r in got if r["v"] == v)
            spot = [at[u] for _, _, u in own]
            out.append((np.array([u for _, _, u in own], np.int64), np.array([y for y, _, _ in own], float), a[spot], b[spot]))
        return out


def co_train(xs: tuple[np.ndarray, np.ndarray], y: np.ndarray, pool: ArrayPool | FramePool, apart: np.ndarray, rounds: int = ROUNDS, most: int = PICK, sure: float = SURE) -> CoTrained:
    """Fit both views on labelled rows `xs`, `y`, exchanging pseudo-labels on `pool`; rows `apart` only calibrate."""
    if not len(y) or y.min() == y.max():
        return CoTrained(None, float(y.mean()) if len(y) else 1.0)
    if y[apart].size < 2 or y[apart].min() == y[apart].max() or y[~apart].size < 2 or y[~apart].min() == y[~apart].max():
        apart = np.ones(len(y), bool)
        train = apart
    else:
        train = ~apart
    prior = float(y[train].mean())
    own = [(xs[v][train], y[train].astype(float)) for v in (0, 1)]
    good = max(1, round(most * prior))
    bad = max(1, most - good)
    fitted = lambda: [(w, _calibrated(w, xs[v][apart], y[apart])) for v in (0, 1) for w in [fit_logistic(*own[v])]]
    views, taken = fitted(), [set(), set()]
    for _ in range(rounds):
        given = pool.surest(views, taken, good, bad, sure)
        if not any(len(g[0]) for g in given):
            break
        for v in (0, 1):
            uid, label, *x = given[v]
            taken[v].update(uid.tolist())
            other = 1 - v
            own[other] = np.concatenate([own[other][0], x[other]]), np.r_[own[other][1], label]
        views = fitted()
    return CoTrained(views, min(max(prior, 1e-3), 1 - 1e-3))


def fit(rows: DataFrame, labels: DataFrame, label_col: str = "quality", labelled: int = LABELLED) -> CoTrained:
    """Fit to a bounded sample of the labelled rows of `features` and to all others."""
    known = pick(labels, doc_id="doc_id", q=label_col).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("q").cast("double").alias("q")).dropna().groupBy("doc_id").agg(F.round(F.avg("q")).cast("int").alias("y"))
    known = written(known, "known")
    first = rows.select("doc_id", "uid").join(known, "doc_id").groupBy("doc_id").agg(F.min("uid").alias("uid"), F.max("y").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(labelled)
    # `first` has at most `labelled` rows, a parameter
    got = rows.join(F.broadcast(first.select("uid", "y")), "uid").select("doc_id", "y", "a", "b").toArrow()
    key = got["doc_id"].to_numpy()
    order = np.argsort(key)
    y, a, b = got["y"].to_numpy()[order], _stacked(got["a"], N_TEXT)[order], _stacked(got["b"], N_META)[order]
    apart = np.array([xxhash.xxh32_intdigest(str(k), 3) % APART == 0 for k in key[order]], bool)
    if known.count() <= BROADCAST_ROWS:
        rest = rows.join(F.broadcast(known.select("doc_id")), "doc_id", "left_anti")
    else:
        rest = written(rows.join(known.select("doc_id"), "doc_id", "left_anti"), "unlabelled")
    return co_train((a, b), y, FramePool(rest), apart)


def score(rows: DataFrame, model: CoTrained) -> DataFrame:
    """doc_id, text_score, meta_score, score of each row of `features`."""
    held = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, 4096):
                batch = whole.slice(i, 4096)
                a, b, c = (pa.array(np.asarray(x, np.float64)) for x in held.value.scores((_stacked(batch["a"], N_TEXT), _stacked(batch["b"], N_META))))
                yield pa.record_batch([batch["doc_id"], a, b, c], names=["doc_id", "text_score", "meta_score", "score"])

    return rows.select("doc_id", "a", "b").mapInArrow(run, "doc_id long, text_score double, meta_score double, score double")


def keep_good(docs: DataFrame, labels: DataFrame, keep_at: float = KEEP_AT) -> DataFrame:
    """`docs` without those scored under `keep_at`. Rows that share an id go together only if all of them do; rows without an id stay."""
    rows = features(docs)
    bad = score(rows, fit(rows, labels)).groupBy("doc_id").agg(F.max("score").alias("s")).where(F.col("s") < keep_at)
    return without(docs, "doc_id", bad.select("doc_id"))


def op7_quality(spark, sf_dir):
    rows = features(table(spark, sf_dir, "documents"))
    return score(rows, fit(rows, table(spark, sf_dir, "labels"))).withColumn("keep", F.col("score") >= KEEP_AT)
