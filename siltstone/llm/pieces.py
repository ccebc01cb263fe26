r"""SentencePiece encoding and decoding with a weighted finite-state transducer.

The transducer is compiled from a model file, as arcs (input, output, weight):

    normaliser   nothing -> U+2581 at the start of a text (the dummy prefix), space -> U+2581, any other character -> itself; weight 0
    pieces       the characters of a piece -> its id, weight -score; a trie shares the arcs of common beginnings
    bytes        a character without a piece of its own -> the byte pieces of its UTF-8 form, weight `_ESCAPE`

For a BPE model an acceptor over ids is composed with these: after piece a, piece b is accepted only where merging
the characters of both by the model's ranks leaves exactly a and b. A sequence of pieces is the merge result just when
each adjacent pair is, so the composition accepts the model's own encoding alone. Its arcs are compiled when they are
first asked for, and remembered, a set number at a time. A unigram model needs no acceptor.

An input is composed with all of this position by position: a state is (position, last piece), or (position) for a
unigram model, and its weight is the least over the arcs that enter it of weight before plus weight of the arc, that is
the shortest path in the tropical semiring (minimum, plus). Ties go to the path found first.

No piece reaches over the end of a word, so the composition falls apart at such places: the factors (a word with
its leading spaces, or a character that no longer piece holds) are solved once each and remembered, a set
number at a time.

Decoding joins the pieces, bytes as they are, and drops the dummy prefix. Encoding is exact: decode(encode(t)) == t for
every text. To that end a literal U+2581 goes to its bytes; the usual library would take it for a space. An
empty text has no ids; a null text has null ids. Repeated rows and null document ids are kept; an empty table gives no
rows; extra columns are ignored, whatever their names. Very long texts take time in proportion to their length.
"""

from __future__ import annotations

import re
import struct
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pick, table

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
UNITS_HELD = 200_000
PAIRS_HELD = 1_000_000
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
_ESCAPE = 1e6  # weight of going to bytes: only where nothing else leads on


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of the fields of a protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        out = shift = 0
        while True:
            b = data[at]
            at += 1
            out |= (b & 127) << shift
            shift += 7
            if b < 128:
                return out

    while at < len(data):
        number, kind = divmod(varint(), 8)
        if kind == 0:
            yield number, varint()
        elif kind in (1, 5):
            size = 8 if kind == 1 else 4
            yield number, data[at : at + size]
            at += size
        else:
            size = varint()
            yield number, data[at : at + size]
            at += size


class Transducer:
    """The compiled model; `encode` and `decode` work on single texts."""

    def __init__(self, data: bytes):
        self.kind, self.dummy, escape_space, squeeze, charsmap, byte_fallback = UNIGRAM, True, True, True, b"", False
        pieces: list[tuple[str, float, int]] = []
        for number, value in _fields(data):
            if number == 1:
                own = dict(_fields(value))
                pieces.append((own[1].decode(), struct.unpack("<f", own.get(2, b"\0\0\0\0"))[0], own.get(3, NORMAL)))
            elif number == 2:
                own = dict(_fields(value))
                self.kind, byte_fallback = own.get(3, UNIGRAM), bool(own.get(35, 0))
            elif number == 3:
                own = dict(_fields(value))
                charsmap, self.dummy, squeeze, escape_space = own.get(2, b""), bool(own.get(3, 1)), bool(own.get(4, 1)), bool(own.get(5, 1))
        if charsmap or squeeze or not escape_space:
            raise ValueError("only the identity normaliser is reversible")
        if self.kind not in (UNIGRAM, BPE) or not byte_fallback or any(k == USER for _, _, k in pieces):
            raise ValueError("a unigram or BPE model with byte fallback and no user symbols is needed")
        self.byte = [0] * 256
        self.out: list[bytes] = []
        self.ids: dict[str, int] = {}
        self.score: list[float] = []
        for i, (text, score, kind) in enumerate(pieces):
            self.score.append(score)
            if kind == BYTE:
                self.byte[int(text[3:5], 16)] = i
                self.out.append(bytes([int(text[3:5], 16)]))
            else:
                self.out.append(text.replace(SPACE, " ").encode() if kind == NORMAL else b"")
                if kind == NORMAL:
                    self.ids[text] = i
        self.trie: dict = {}
        for text, i in self.ids.items():
            if self.kind == UNIGRAM or self.merged(text) == [text]:
                node = self.trie
                for c in text:
                    node = node.setdefault(c, {})
                node[""] = i, -self.score[i]
        self.text = {i: t for t, i in self.ids.items()}
        self.longest = max(map(len, self.ids), default=1)
        self.base = len(pieces)  # ids from here on stand for single characters that go to bytes
        inside = {c for t in self.ids if len(t) > 1 for c in t} - {SPACE}
        if any(re.search(f"[^{SPACE}]{SPACE}", t) for t in self.ids):
            self.cut = None  # some piece reaches over the end of a word
        else:
            letters = "".join(re.escape(c) for c in sorted(inside))
            self.cut = re.compile(f"{SPACE}*[{letters}]+|{SPACE}+|.", re.S) if letters else re.compile(f"{SPACE}+|.", re.S)
        self._reset()

    def _reset(self):
        self.units: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.rows: dict[int, dict[int, bool]] = {}  # compiled arcs of the acceptor
        self.compiled = 0

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("units", "old", "rows", "compiled")}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self._reset()

    def merged(self, text: str) -> list[str]:
        """The characters of a short text merged by rank: the best pair first, the leftmost of equals."""
        parts = list(text)
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                piece = self.ids.get(parts[i] + parts[i + 1])
                if piece is not None and (best is None or self.score[piece] > best):
                    best, at = self.score[piece], i
            if best is None:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def _spelled(self, i: int) -> str:
        return self.text[i] if i < self.base else chr(i - self.base)

    def _accepts(self, a: int, b: int) -> bool:
        """Compile an arc of the acceptor: whether pieces a and b may stand side by side in a BPE encoding."""
        x, y = self._spelled(a), self._spelled(b)
        self.compiled += 1
        return self.merged(x + y) == [x, y]

    def _arcs(self, text: str, at: int) -> list[tuple[int, int, float]]:
        """(piece, end, weight) of the arcs from a position of normalised text, shortest first; the bytes of a character without a piece first of all."""
        out = [] if text[at] in self.ids else [(self.base + ord(text[at]), at + 1, _ESCAPE)]
        node, end = self.trie, at
        for c in text[at : at + self.longest]:
            if c not in node:
                break
            node, end = node[c], end + 1
            if "" in node:
                piece, weight = node[""]
                out.append((piece, end, weight))
        return out

    def shortest(self, text: str) -> list[int]:
        """Pieces on the path of least weight; ids from `base` on are characters that go to bytes."""
        if self.compiled >= PAIRS_HELD:
            self.rows.clear()
            self.compiled = 0
        return self._bpe_path(text) if self.kind == BPE else self._unigram_path(text)

    def _unigram_path(self, text: str) -> list[int]:
        """States are positions: (weight, position before, piece)."""
        states: list[tuple[float, int, int] | None] = [(0.0, -1, -1)] + [None] * len(text)
        for at in range(len(text)):
            here = states[at]
            if here is not None:
                for piece, end, weight in self._arcs(text, at):
                    old = states[end]
                    if old is None or here[0] + weight < old[0]:
                        states[end] = here[0] + weight, at, piece
        out, at = [], len(text)
        while at:
            _, at, piece = states[at]
            out.append(piece)
        return out[::-1]

    def _bpe_path(self, text: str) -> list[int]:
        """States are (position, last piece): weight, position before, last piece before."""
        size, rows = len(text), self.rows
        if not size:
            return []
        states: list[dict[int, tuple[float, int, int]] | None] = [None] * (size + 1)
        for piece, end, weight in self._arcs(text, 0):
            states[end] = {piece: (weight, 0, -1)}
        for at in range(1, size):
            here = states[at]
            if here is None:
                continue
            arcs = self._arcs(text, at)
            for last, state in here.items():
                before, row = state[0], rows.get(last)
                if row is None:
                    row = rows[last] = {}
                for piece, end, weight in arcs:
                    ok = row.get(piece)
                    if ok is None:
                        ok = row[piece] = self._accepts(last, piece)
                    if ok:
                        there = states[end]
                        if there is None:
                            states[end] = {piece: (before + weight, at, last)}
                        else:
                            old = there.get(piece)
                            if old is None or before + weight < old[0]:
                                there[piece] = before + weight, at, last
        end = states[size]
        last, at, out = min(end, key=lambda k: end[k][0]), size, []
        while at:
            out.append(last)
            _, at, last = states[at][last]
        return out[::-1]

    def _unit(self, text: str) -> bytes:
        ids = self.shortest(text)
        if ids and max(ids) >= self.base:
            ids = [b for i in ids for b in ([i] if i < self.base else [self.byte[c] for c in chr(i - self.base).encode()])]
        return array("i", ids).tobytes()

    def encode_bytes(self, text: str) -> bytes:
        """The ids as little-endian 32-bit integers."""
        out: list[bytes] = []
        units = self.units
        for k, part in enumerate(text.split(SPACE)):
            if k:
                out.append(np.array([self.byte[b] for b in SPACE.encode()], "<i4").tobytes())
            norm = (SPACE if self.dummy and not k and text else "") + part.replace(" ", SPACE)
            for unit in self.cut.findall(norm) if self.cut else [norm] * bool(norm):
                got = units.get(unit)
                if got is None:
                    if len(units) >= UNITS_HELD:  # the generation before stays in reach
                        self.old, self.units = units, {}
                        units = self.units
                    got = units[unit] = self.old.get(unit) or self._unit(unit)
                out.append(got)
        return b"".join(out)

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_bytes(text), "<i4").tolist()

    def decode(self, ids: list[int]) -> str:
        data = b"".join(map(self.out.__getitem__, ids))
        return (data[1:] if self.dummy and data[:1] == b" " else data).decode("utf-8", "replace")


def load(path: str = MODEL) -> Transducer:
    with open(path, "rb") as f:
        return Transducer(f.read())


def encode(docs: DataFrame, transducer: Transducer, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids, n_tokens, exact) of each row; exact says that the ids decode to the text."""
    own = pick(docs, id=id_col, text=text_col).select("id", F.col("text").cast("string").alias("text"))
    kind = own.schema["id"].dataType.simpleString()
    held = docs.sparkSession.sparkContext.broadcast(transducer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = held.value
        for whole in batches:
            for i in range(0, whole.num_rows, 512):
                batch = whole.slice(i, 512)
                texts = batch["text"].to_pylist()
                flat = [b"" if x is None else t.encode_bytes(x) for x in texts]
                lens = np.array([len(b) // 4 for b in flat], np.int64)
                ids = np.frombuffer(b"".join(flat), "<i4")
                edge = np.r_[0, np.cumsum(lens)].astype(np.int32)
                null = np.array([x is None for x in texts], bool)
                rows = pa.ListArray.from_arrays(pa.array(edge, mask=np.r_[null, False]), pa.array(ids))
                listed, exact = ids.tolist(), []
                for x, a, b in zip(texts, edge.tolist(), edge[1:].tolist()):
                    exact.append(x is not None and t.decode(listed[a:b]) == x)
                yield pa.record_batch([batch["id"], rows, pa.array(lens), pa.array(exact)], names=["id", "ids", "n_tokens", "exact"])

    return own.mapInArrow(run, f"id {kind}, ids array<int>, n_tokens long, exact boolean")


def decode(encoded: DataFrame, transducer: Transducer, id_col: str = "id") -> DataFrame:
    """(id, text) of rows with a column `ids`; null ids give a null text. Ids outside the model are an error."""
    own = pick(encoded, id=id_col, ids="ids").select("id", F.col("ids").cast("array<int>").alias("ids"))
    kind = own.schema["id"].dataType.simpleString()
    held = encoded.sparkSession.sparkContext.broadcast(transducer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [None if ids is None else held.value.decode(ids) for ids in batch["ids"].to_pylist()]
            yield pa.record_batch([batch["id"], pa.array(texts, pa.string())], names=["id", "text"])

    return own.mapInArrow(run, f"id {kind}, text string")


def op9_pieces(spark, sf_dir):
    return encode(table(spark, sf_dir, "documents"), load()).withColumnRenamed("id", "doc_id")
