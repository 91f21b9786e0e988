"""SentencePiece encoding and decoding by a max-plus parallel scan.

The model is a piece vocabulary of the BPE kind with byte fallback. A token sequence is the BPE
encoding of its text exactly if each pair of neighbours is the encoding of its own text: until
a first merge across a token boundary, both sides merge as they would alone. So encoding is a path
in the lattice of pieces in which an edge between neighbours weighs 0 if the pair is stable and
minus infinity if not; the best path has weight 0 and is the only such one.

A text is cut where a word starts: no piece holds a space mark after another character (this is
checked when the model is loaded), so there the lattice has one state. Runs beyond `RUN` characters
without such a place, and documents beyond `CHARS` characters, are cut anywhere. A chunk's
boundary states are the pieces that reach over or end at its cut; a chunk yields the
max-plus transfer matrix from the states of its left cut to those of its right cut. Matrices are
combined associatively, which tells every chunk its states on the best path, and each chunk is
then backtraced for itself. Documents beyond CHARS are spread over tasks in this way.

Defined results
---------------
- null or empty text: no tokens, decoded to the empty string;
- characters without a piece: their UTF-8 bytes as byte pieces;
- the mark U+2581 in a text is read as a space, as the model's own normaliser has it;
- decoding bytes that are no UTF-8 gives U+FFFD for each;
- null doc_id and repeated rows: each row gets its own result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import sys
import types

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, small_batches

#: Characters of a document that one task row holds; longer documents are spread.
CHARS = 1 << 16
#: Characters without a word start that are scanned as one chunk.
RUN = 256
#: Words of each of two generations, and pairs of pieces, that a worker remembers.
WORDS, PAIRS = 600_000, 200_000
_MARK = "▁"
_NONE = -np.inf


class Codec:
    def __init__(self, pieces: list[tuple[str, float, int]]):
        """`pieces`: (piece, score, type) in the order of ids; types as in the model: 1 normal, 2 unknown, 3 control, 4 user-defined, 6 byte."""
        self.score = {p: s for p, s, kind in pieces if kind in (1, 4)}
        self.id = {p: i for i, (p, _, kind) in enumerate(pieces) if kind in (1, 4)}
        self.unknown = next((i for i, p in enumerate(pieces) if p[2] == 2), 0)
        self.byte = {int(p[3:5], 16): i for i, (p, _, kind) in enumerate(pieces) if kind == 6}
        self.longest = max((len(p) for p in self.id), default=1)
        self.by_word = not any(_MARK in p.lstrip(_MARK) for p in self.id)
        self.parts = re.compile(f"{_MARK}*[^{_MARK}]+|{_MARK}+") if self.by_word else re.compile(r"[\s\S]+")
        shown = [b""] * (max(max(self.id.values(), default=0), max(self.byte.values(), default=0), self.unknown) + 1)
        for p, i in self.id.items():
            shown[i] = p.replace(_MARK, " ").encode()
        for b, i in self.byte.items():
            shown[i] = bytes([b])
        self.raw = np.zeros(len(shown), bool)
        self.raw[list(self.byte.values())] = True
        self.flat = np.frombuffer(b"".join(shown), np.uint8)
        self.size = np.array([len(x) for x in shown], np.int64)
        self.place = np.concatenate([[0], np.cumsum(self.size)])[:-1]
        self.code = {p: i.to_bytes(4, "little") for p, i in self.id.items()}
        self._edges()
        self._stable: dict[tuple[str, str], bool] = {}
        self._words = _Words(self)

    @classmethod
    def load(cls, path: str) -> Codec:
        from sentencepiece import sentencepiece_model_pb2 as proto

        model = proto.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        spec = model.normalizer_spec
        if model.trainer_spec.model_type != 2 or spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.add_dummy_prefix:
            raise ValueError("a BPE model with an identity normaliser and a dummy prefix is needed")
        return cls([(p.piece, p.score, p.type) for p in model.pieces])

    def _steps(self, text: str) -> tuple[list[str], tuple[str, str] | None]:
        """The plain definition: the best-scored neighbours merge, the leftmost of equals, until none can; and the last two that did."""
        parts, last = list(text), None
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = self.score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if at < 0:
                break
            last = (parts[at], parts[at + 1])
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts, last

    def merged(self, text: str) -> list[str]:
        return self._steps(text)[0]

    def _edges(self) -> None:
        """For each piece, what stands at its two ends while it is being merged: (string, born at score, taken in at score).

        Where every piece scores less than the two it is merged from, merges happen in the order of scores,
        so two pieces are stable if no two strings that stand at the cut at one time have a merge that comes
        before either is taken in. Other pieces (`odd`) are compared by merging.
        """
        self.kind: dict[str, bool] = {}
        self.left: dict[str, tuple] = {}
        self.right: dict[str, tuple] = {}
        self.odd: set[str] = set()
        inf = float("inf")
        for p in sorted(self.id, key=len):
            whole, last = self._steps(p)
            if whole != [p]:
                continue  # no merges lead to it
            for n in range(1, len(p)):
                self.kind.setdefault(p[:n], False)
            self.kind[p] = True
            if last is None:
                self.left[p] = self.right[p] = ((p, inf, -inf),)
                continue
            one, two, score = *last, self.score[p]
            for x in last:  # a character without a piece of its own
                if x not in self.left:
                    self.left[x] = self.right[x] = ((x, inf, -inf),)
            for spines, child in ((self.left, one), (self.right, two)):
                *below, (top, born, _) = spines[child]
                spines[p] = (*below, (top, born, score), (p, score, -inf))
            if score >= min(self.left[one][-1][1], self.left[two][-1][1]) or one in self.odd or two in self.odd:
                self.odd.add(p)

    def _ends(self, p: str, spines: dict) -> tuple:
        return spines.get(p) or ((p, float("inf"), float("-inf")),)

    def stable(self, left: str, right: str) -> bool:
        """Whether an edge from one piece to the next weighs 0; an empty left stands for the text's start."""
        if not left:
            return len(right) == 1 or self.kind.get(right, False)
        found = self._stable.get((left, right))
        if found is None:
            if len(self._stable) >= PAIRS:
                self._stable.clear()
            found = self._stable[left, right] = self._compatible(left, right)
        return found

    def _compatible(self, left: str, right: str) -> bool:
        if left in self.odd or right in self.odd:
            return self.merged(left + right) == [left, right]
        score = self.score.get
        for u, born, taken in self._ends(left, self.right):
            for v, born2, taken2 in self._ends(right, self.left):
                if taken < born2 and taken2 < born:
                    c = score(u + v)
                    # of equals, the leftmost comes first: what takes u in stands left of the cut, what takes v in right of it
                    if c is not None and c > taken and c >= taken2:
                        return False
        return True

    def _piece(self, p: str) -> bool:
        return len(p) == 1 or self.kind.get(p, False)

    def _scan(self, text: str, start: int, end: int, entry: str, at: int) -> list[str]:
        """The pieces from `at`, after the piece `entry`, up to the one that ends at `end`: forward values, as far as they are asked for, and backtrace.

        `start` is where entry begins. Each prefix has one stable last piece at most, so its value is that piece.
        """
        last: list = [None] * (end - at + 1)
        last[0] = entry
        if end - at > RUN:
            # in order, so that no value asks for more than values at hand: `_last` calls itself once for each piece back to the start
            for e in range(at + 1, end):
                self._last(text, e, at, last)
        out, e = [], end
        while e > at:
            p = last[e - at] or self._last(text, e, at, last)
            if not p:
                raise ValueError("no stable path")
            out.append(p)
            e -= len(p)
        return out[::-1]

    def _last(self, text: str, e: int, at: int, last: list) -> str | bool:
        """The last piece of the best path to `e`, or False if none is stable; longer pieces are tried first."""
        kind, known = self.kind.get, self._stable.get
        for s in range(at if e - at < self.longest else e - self.longest, e):
            p = text[s:e]
            if kind(p) or e - s == 1:
                left = last[s - at]
                if left is None:
                    left = self._last(text, s, at, last)
                if left is not False:
                    fits = known((left, p))
                    if fits or fits is None and self.stable(left, p):
                        last[e - at] = p
                        return p
        last[e - at] = False
        return False

    def states(self, text: str, cut: int) -> list[tuple[int, int]]:
        """Pieces (start, end) with start < cut <= end; at the text's start, the empty piece."""
        if cut == 0:
            return [(0, 0)]
        out = []
        for s in range(max(0, cut - self.longest), cut):
            for e in range(cut, min(len(text), s + self.longest) + 1):
                if self._piece(text[s:e]):
                    out.append((s, e))
        return out

    def transfer(self, text: str, left: int, right: int) -> np.ndarray:
        """Max-plus matrix from the states of `left` to those of `right`: 0 where a stable path leads, else minus infinity."""
        enter, leave = self.states(text, left), self.states(text, right)
        column = {s: i for i, s in enumerate(leave)}
        out = np.full((len(enter), len(leave)), _NONE)
        ending: dict[int, dict[tuple[int, int], np.ndarray]] = {}
        for i, s in enumerate(enter):
            if s[1] >= right and s in column:
                out[i, column[s]] = 0
            elif s[1] < right:
                row = np.full(len(enter), _NONE)
                row[i] = 0
                ending.setdefault(s[1], {})[s] = row
        for at in range(left, right):
            before = ending.pop(at, None)
            if not before:
                continue
            for e in range(at + 1, min(len(text), at + self.longest) + 1):
                p = text[at:e]
                if not self._piece(p):
                    continue
                rows = [row for (s, t), row in before.items() if self.stable(text[s:t], p)]
                if rows:
                    row = np.maximum.reduce(rows)
                    if e >= right:
                        out[:, column[at, e]] = np.maximum(out[:, column[at, e]], row)
                    else:
                        ending.setdefault(e, {})[at, e] = row
        return out

    def backtrace(self, text: str, left: int, right: int, enter: tuple[int, int], leave: tuple[int, int]) -> list[str]:
        """The pieces after `enter` up to and with `leave`, which has to be the best path's."""
        if leave == enter:
            return []
        return self._scan(text, enter[0], leave[1], text[enter[0] : enter[1]], enter[1])

    def long_run(self, text: str) -> list[str]:
        """A run without a word start, by chunks of RUN characters."""
        cuts = list(range(0, len(text), RUN)) + [len(text)]
        path = best_path([self.transfer(text, a, b) for a, b in zip(cuts, cuts[1:])])
        states = [self.states(text, c)[i] for c, i in zip(cuts, path)]
        return [p for a, b, s, t in zip(cuts, cuts[1:], states, states[1:]) for p in self.backtrace(text, a, b, s, t)]

    def ids(self, pieces: list[str]) -> bytes:
        """Token ids of pieces, as little-endian 32-bit integers; a character without a piece is its bytes."""
        code = self.code
        return b"".join([code.get(p) or self._fallback(p) for p in pieces])

    def _fallback(self, p: str) -> bytes:
        ids = [self.byte[b] for b in p.encode()] if self.byte else [self.unknown]
        return np.array(ids, dtype="<i4").tobytes()

    def word(self, w: str) -> bytes:
        return self._words[w]

    def _encoded(self, w: str) -> bytes:
        return self.ids(self._scan(w, 0, len(w), "", 0) if len(w) <= RUN else self.long_run(w))

    def encode(self, text: str | None) -> bytes:
        """Token ids, as little-endian 32-bit integers."""
        if not text:
            return b""
        if self.by_word and "  " not in text and _MARK not in text and text[0] != " " and text[-1] != " ":
            return b"".join(map(self._words.__getitem__, text.split(" ")))
        return self.encode_marked(mark(text))

    def encode_marked(self, marked: str) -> bytes:
        words = self._words
        # remembered without their mark, if it is one that starts them
        return b"".join([words[p[1:]] if p[0] == _MARK and p[1:2] != _MARK and len(p) > 1 else self._encoded(p) for p in self.parts.findall(marked)])

    def decode(self, ids: bytes, first: bool = True) -> str:
        """The text of token ids; `first`: they start a text, whose dummy prefix goes."""
        i = np.frombuffer(ids, dtype="<i4")
        size = self.size[i]
        end = np.cumsum(size)
        total = int(end[-1]) if len(end) else 0
        raw = self.flat[np.repeat(self.place[i] - (end - size), size) + np.arange(total)].tobytes()
        try:
            text = raw.decode()
        except UnicodeDecodeError:
            text = self._mended(i, size, end, raw)
        return text[1:] if first and text.startswith(" ") else text

    def _mended(self, i: np.ndarray, size: np.ndarray, end: np.ndarray, raw: bytes) -> str:
        """Runs of byte pieces that are no UTF-8 have U+FFFD in their place."""
        out, since = [], 0
        byte = self.raw[i]
        edge = np.flatnonzero(np.diff(np.concatenate([[False], byte, [False]]).astype(np.int8)))
        for a, b in zip(edge[0::2], edge[1::2]):
            low, high = int(end[a] - size[a]), int(end[b - 1])
            out += [raw[since:low], _utf8(raw[low:high])]
            since = high
        return b"".join([*out, raw[since:]]).decode()


class _Words(dict):
    """Word (without its mark) -> ids, of two generations: what is in use moves to the new one, what is not goes with the old."""

    def __init__(self, codec: Codec):
        super().__init__()
        self.codec, self.old = codec, {}

    def __missing__(self, w: str) -> bytes:
        if len(w) > 64:
            return self.codec._encoded(_MARK + w)
        found = self.old.get(w)
        if found is None:
            found = self.codec._encoded(_MARK + w)
        if len(self) >= WORDS:
            self.old = dict(self)
            self.clear()
        self[w] = found
        return found


def _utf8(raw: bytes) -> bytes:
    """Bytes that are no UTF-8 become U+FFFD, each."""
    out, i = [], 0
    while i < len(raw):
        for n in (1, 2, 3, 4):
            try:
                out.append(raw[i : i + n].decode().encode())
                i += n
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append("�".encode())
            i += 1
    return b"".join(out)


def mark(text: str) -> str:
    return _MARK + text.replace(" ", _MARK)


def combine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The max-plus product."""
    return (a[:, :, None] + b[None]).max(axis=1) if b.size and a.size else np.full((a.shape[0], b.shape[1]), _NONE)


def best_path(matrices: list[np.ndarray]) -> list[int]:
    """The state at each cut on the best path through a chain of transfer matrices, from the text's start to its end."""
    reached = [np.zeros((1, 1))]
    for m in matrices:
        reached.append(combine(reached[-1], m))
    path = [int(np.argmax(reached[-1][0]))]
    for m, v in zip(reversed(matrices), reversed(reached[:-1])):
        path.append(int(np.argmax(v[0] + m[:, path[-1]])))
    return path[::-1]


def _worker(path: str) -> Codec:
    """One codec for each worker process, whatever number of tasks it runs."""
    held = sys.modules.setdefault("_loom_codecs", types.ModuleType("_loom_codecs")).__dict__
    if path not in held:
        held[path] = Codec.load(path)
    return held[path]


_ENCODED = "doc_id long, row long, part int, text string, ids binary"


def _encode(docs: DataFrame, model: str, finish, schema: str, scratch: Scratch | None) -> tuple[DataFrame, DataFrame]:
    """Encodes every row, (documents of one part, parts of longer ones); `finish` makes the columns of `schema` of (codec, doc_id, row, part, texts, ids) in the same worker."""
    spark = docs.sparkSession
    small_batches(spark)
    scratch = scratch or Scratch(spark, "pieces")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    names = [c.split()[0] for c in schema.split(", ")]

    def whole(batches):
        codec = _worker(model)
        for batch in batches:
            n, texts = batch.num_rows, batch.column("text").to_pylist()
            ids = list(map(codec.encode, texts))
            yield pa.RecordBatch.from_arrays(finish(codec, batch.column("doc_id"), pa.nulls(n, pa.int64()), pa.array([0] * n, pa.int32()), texts, ids), names)

    short = rows.where(F.coalesce(F.length("text"), F.lit(0)) <= CHARS).mapInArrow(whole, schema)

    # longer documents: marked, and cut into parts with the neighbourhood of their cuts
    side = 64
    marked = F.concat(F.lit(_MARK), F.translate("text", " ", _MARK))
    long_ = rows.where(F.length("text") > CHARS).select("doc_id", F.monotonically_increasing_id().alias("row"), marked.alias("m"))
    long_ = long_.withColumn("size", F.length("m")).withColumn("part", F.explode(F.sequence(F.lit(0), F.floor((F.col("size") - 1) / CHARS).cast("int"))))
    low = F.greatest(F.lit(0), F.col("part") * CHARS - side)
    parts = scratch.cut(
        long_.select(
            "doc_id", "row", "part", (F.col("part") * CHARS - low).alias("left"),
            (F.least(F.col("size"), (F.col("part") + 1) * CHARS) - low).alias("right"),
            F.substring("m", low + 1, F.lit(CHARS + 2 * side)).alias("m"),
        ), "parts",
    )

    def matrices(batches):
        codec = _worker(model)
        for batch in batches:
            out = []
            for m, a, b in zip(*(batch.column(c).to_pylist() for c in ("m", "left", "right"))):
                t = part_transfer(codec, m, a, b)
                out.append((t.shape[0], t.shape[1], (t == 0).tobytes()))
            n, k, t = zip(*out) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("part"), pa.array(n, pa.int32()), pa.array(k, pa.int32()), pa.array(t, pa.binary())], ["row", "part", "n", "k", "t"])

    def states(pdf):
        import pandas as pd

        pdf = pdf.sort_values("part")
        chain = [np.where(np.frombuffer(t, bool).reshape(n, k), 0.0, _NONE) for t, n, k in zip(pdf["t"], pdf["n"], pdf["k"])]
        path = best_path(chain)
        return pd.DataFrame({"row": pdf["row"], "part": pdf["part"], "enter": path[:-1], "leave": path[1:]})

    cuts = parts.mapInArrow(matrices, "row long, part int, n int, k int, t binary").groupBy("row").applyInPandas(states, "row long, part int, enter int, leave int")

    def traced(batches):
        codec = _worker(model)
        for batch in batches:
            cols = [batch.column(c).to_pylist() for c in ("m", "left", "right", "enter", "leave")]
            ids = [part_ids(codec, m, a, b, s, t) for m, a, b, s, t in zip(*cols)]
            texts = [m[a:b].replace(_MARK, " ") for m, a, b in zip(*cols[:3])]
            yield pa.RecordBatch.from_arrays(finish(codec, batch.column("doc_id"), batch.column("row"), batch.column("part"), texts, ids), names)

    return short, parts.join(cuts, ["row", "part"]).mapInArrow(traced, schema)


def encode(docs: DataFrame, model: str, scratch: Scratch | None = None) -> DataFrame:
    """doc_id, row, part, text, ids of `docs` (doc_id, text): one row for each document, or for CHARS characters of a longer one.

    `model` is the path of the model file on every node. `ids` are little-endian 32-bit integers; `row` tells the rows
    of a document of several parts, and is null for others.
    """
    short, spread = _encode(docs, model, lambda codec, doc, row, part, texts, ids: [doc, row, part, pa.array(texts, pa.string()), pa.array(ids, pa.binary())], _ENCODED, scratch)
    return short.unionByName(spread)


def _segments(codec: Codec, m: str, left: int, right: int) -> tuple[int, int]:
    """The first and the last word start inside a part: between them, words stand for themselves."""
    if not codec.by_word:
        return right, right
    first = re.compile(f"(?<=[^{_MARK}]){_MARK}").search(m, left, right)
    if first is None:
        return right, right
    last = m.rfind(_MARK, left, right)
    while last > first.start() and m[last - 1] == _MARK:
        last -= 1
    return first.start(), last


def part_transfer(codec: Codec, m: str, left: int, right: int) -> np.ndarray:
    """A part's transfer matrix: the product over the stretch to its first word start, the words, and the stretch from the last."""
    a, b = _segments(codec, m, left, right)
    if a >= right:
        cuts = [*range(left, right, RUN), right]
    else:
        cuts = sorted({*range(left, a, RUN), a, b, *range(b, right, RUN), right})
    out = None
    for x, y in zip(cuts, cuts[1:]):
        if (x, y) == (a, b):
            # one state at either word start, the piece that ends there: 0 from each that ends at a to the one before b
            t = np.full((len(codec.states(m, a)), len(codec.states(m, b))), _NONE)
            w = codec.parts.findall(m[a:b])[-1]
            last = (codec._scan(w, 0, len(w), "", 0) if len(w) <= RUN else codec.long_run(w))[-1]
            ends = [i for i, s in enumerate(codec.states(m, a)) if s[1] == a]
            t[ends, codec.states(m, b).index((b - len(last), b))] = 0
        else:
            t = codec.transfer(m, x, y)
        out = t if out is None else combine(out, t)
    return out


def part_ids(codec: Codec, m: str, left: int, right: int, enter: int, leave: int) -> bytes:
    """Ids of the pieces that start in a part, after its entering state."""
    s, t = codec.states(m, left)[enter], codec.states(m, right)[leave]
    a, b = _segments(codec, m, left, right)
    if s == t:
        return b""
    if a >= right or a < s[1] or b > t[0]:
        return codec.ids(codec._scan(m, s[0], t[1], m[s[0] : s[1]], s[1]))
    head = codec._scan(m, s[0], a, m[s[0] : s[1]], s[1]) if a > s[1] else []
    # from a word start on, the entering piece does not matter
    tail = codec._scan(m, b, t[1], "", b)
    return codec.ids(head) + codec.encode_marked(m[a:b]) + codec.ids(tail)


def decode(encoded: DataFrame, model: str) -> DataFrame:
    """`encoded` (row, part, ids and others) with `decoded`, the text of the ids of each row."""

    def run(batches):
        codec = _worker(model)
        for batch in batches:
            text = [codec.decode(i, p == 0) for i, p in zip(batch.column("ids").to_pylist(), batch.column("part").to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(text, pa.string())], [*batch.schema.names, "decoded"])

    return encoded.mapInArrow(run, encoded.select("*", F.lit("").alias("decoded")).schema)


def _digests(ids: list[bytes], texts: list[str | None], back: list[str]) -> list[pa.Array]:
    return [
        pa.array([len(i) // 4 for i in ids], pa.int64()), pa.array([hashlib.sha256(i).hexdigest() for i in ids], pa.string()),
        pa.array([hashlib.sha256(b.encode()).hexdigest() for b in back], pa.string()), pa.array([b == (t or "").replace(_MARK, " ") for t, b in zip(texts, back)], pa.bool_()),
    ]


_DIGEST = "n_tokens long, ids_sha256 string, decoded_sha256 string, exact boolean"


def digest(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, exact of every row of `docs` (doc_id, text).

    `ids_sha256`: of the ids as little-endian 32-bit integers; `exact`: the text came back, its marks as spaces. A
    document is encoded, decoded and digested in one worker; of longer ones, the parts are.
    """

    def finish(codec, doc, row, part, texts, ids):
        back = [codec.decode(i, p == 0) for i, p in zip(ids, part.to_pylist())]
        done = row.null_count == len(row)
        kept = [pa.nulls(len(ids), pa.binary()), pa.nulls(len(ids), pa.string()), pa.nulls(len(ids), pa.string())] if done else [pa.array(ids, pa.binary()), pa.array(texts, pa.string()), pa.array(back, pa.string())]
        return [doc, row, part, *kept, *_digests(ids, texts, back)]

    one, parts = _encode(docs, model, finish, f"doc_id long, row long, part int, ids binary, text string, decoded string, {_DIGEST}", None)

    def joined(batches):
        for batch in batches:
            whole = [[("".join if c != "ids" else b"".join)([p[c] for p in ps]) for ps in batch.column("p").to_pylist()] for c in ("ids", "text", "decoded")]
            ids, texts, back = whole
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *_digests(ids, [t[1:] for t in texts], back)], ["doc_id", *[c.split()[0] for c in _DIGEST.split(", ")]])

    names = ["doc_id", *[c.split()[0] for c in _DIGEST.split(", ")]]
    # the parts of one document meet, as its row of the input did
    many = parts.groupBy("doc_id", "row").agg(F.sort_array(F.collect_list(F.struct("part", "ids", "text", "decoded"))).alias("p"))
    return one.select(*names).unionByName(many.mapInArrow(joined, f"doc_id long, {_DIGEST}"))
