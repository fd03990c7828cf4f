"""SentencePiece encoding and decoding as shortest paths through a weighted transducer.

A model file is compiled into three machines. The normaliser rewrites a text: its rules
(longest match first), then white space to U+2581. The piece machine is a trie whose arcs read one code point and
whose final states emit a piece; a code point that is no piece has an arc of its own, which byte fallback turns into
byte pieces. Composed with an input, the piece machine becomes a lattice with an
arc from i to j for each piece that spells text[i:j]. Encoding is the path of least weight in the
tropical semiring (weights add along a path, the least wins), found position by position.

* Unigram models: an arc weighs minus the score of its piece.
* BPE models: a sequence of pieces is what merging yields exactly if merging each two
  neighbours alone yields these two. (Up to the first merge across a border all spans develop as they do alone.)
  So the machine remembers the last piece, and a transition weighs 0 if the
  pair is stable and infinity if not. One path is finite, and it is the encoding.

Lattices are built and searched for many words at a time with numpy; a word is a stretch of text that no piece
reaches out of. Words are remembered per worker up to a fixed number, the rest is worked out again.

Defined results: a null text has null ids and a null decoded text; an empty text has no ids. Other columns,
repeated rows and null ids pass through. `text` and `ids` columns of the same name are replaced.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SPACE = "▁"
# Kinds of pieces and models in the model file.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
UNKNOWN_PENALTY = 10.0

REMEMBERED = 200_000  # words per worker
SLICE = 512  # texts encoded together
_LONG = 64  # longer words are searched a few at a time
_NONE = -1
_NEVER = np.iinfo(np.int64).max


# --- the model file -------------------------------------------------------------------


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of each field of a message in protocol buffer wire format."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        elif kind == 2:
            size = varint()
            yield key >> 3, data[at : at + size]
            at += size
        else:
            size = 4 if kind == 5 else 8
            yield key >> 3, data[at : at + size]
            at += size


def _rules(charsmap: bytes) -> dict[str, str]:
    """The rewriting rules in a compiled map: a double-array trie of sources, then zero-terminated targets."""
    if not charsmap:
        return {}
    (size,) = struct.unpack_from("<I", charsmap)
    units = np.frombuffer(charsmap, "<u4", size // 4, 4).tolist()
    targets = charsmap[4 + size :]
    rules: dict[str, str] = {}

    def offset(unit: int) -> int:
        return (unit >> 10) << ((unit & 512) >> 6)

    stack = [(offset(units[0]), b"")]
    while stack:
        node, prefix = stack.pop()
        for byte in range(1, 256):
            at = node ^ byte
            if at < len(units) and units[at] & 0x800000FF == byte:
                unit = units[at]
                below = at ^ offset(unit)
                if unit & 256:
                    start = units[below] & 0x7FFFFFFF
                    rules[(prefix + bytes([byte])).decode("utf-8", "replace")] = targets[
                        start : targets.index(0, start)
                    ].decode()
                stack.append((below, prefix + bytes([byte])))
    return rules


class Model:
    """Pieces, scores and settings of a model file."""

    def __init__(self, data: bytes):
        self.pieces: list[str] = []
        self.scores: list[float] = []
        self.kinds: list[int] = []
        self.type, self.byte_fallback, self.unknown_surface = UNIGRAM, False, " ⁇ "
        self.dummy_prefix, self.trim, self.escape = True, True, True
        self.rules: dict[str, str] = {}
        for field, value in _fields(data):
            if field == 1:
                piece = dict(_fields(value))
                self.pieces.append(piece[1].decode())
                self.scores.append(struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0)
                self.kinds.append(piece.get(3, NORMAL))
            elif field == 2:
                trainer = dict(_fields(value))
                self.type = trainer.get(3, UNIGRAM)
                self.byte_fallback = bool(trainer.get(35, 0))
                self.unknown_surface = trainer[44].decode() if 44 in trainer else self.unknown_surface
            elif field == 3:
                normaliser = dict(_fields(value))
                self.rules = _rules(normaliser.get(2, b""))
                self.dummy_prefix = bool(normaliser.get(3, 1))
                self.trim = bool(normaliser.get(4, 1))
                self.escape = bool(normaliser.get(5, 1))
        if self.type not in (UNIGRAM, BPE):
            raise ValueError("only unigram and BPE models can be compiled")
        if USER_DEFINED in self.kinds:
            raise ValueError("models with user-defined pieces are not supported")
        self.unknown = self.kinds.index(UNKNOWN) if UNKNOWN in self.kinds else 0


# --- the machines ---------------------------------------------------------------------


class Normaliser:
    """Rewriting rules, longest match first, then white space."""

    def __init__(self, model: Model):
        self.model = model
        self.longest = max(map(len, model.rules), default=0)
        first = "".join(re.escape(c) for c in sorted({k[0] for k in model.rules}))
        self.starts = re.compile(f"[{first}]") if first else None

    def __call__(self, text: str) -> str:
        m = self.model
        if self.starts is not None:
            done, at = [], 0
            while hit := self.starts.search(text, at):
                done.append(text[at : hit.start()])
                at = hit.start()
                for size in range(min(self.longest, len(text) - at), 0, -1):
                    if (target := m.rules.get(text[at : at + size])) is not None:
                        done.append(target)
                        at += size
                        break
                else:
                    done.append(text[at])
                    at += 1
            text = "".join(done) + text[at:]
        if m.trim:
            text = re.sub(" +", " ", text.strip(" "))
        if text and m.dummy_prefix:
            text = " " + text
        return text.replace(" ", SPACE) if m.escape else text


class Machine:
    """The compiled model: encodes many words at a time."""

    def __init__(self, data: bytes):
        model = self.model = Model(data)
        self.normalise = Normaliser(model)
        size = self.size = len(model.pieces)
        matched = [i for i in range(size) if model.kinds[i] == NORMAL and model.pieces[i]]
        self.ids = {model.pieces[i]: i for i in reversed(matched)}
        self.priority = {p: model.scores[i] for p, i in self.ids.items()}
        self._compile_trie()
        self._compile_cuts()
        worst = min((model.scores[i] for i in matched), default=0.0)
        # Single precision, as the scores are: so paths that tie but for rounding fall the usual way.
        self.weights = -np.array([*model.scores, worst - UNKNOWN_PENALTY], np.float32)
        self.bytes = {int(model.pieces[i][3:5], 16): i for i in range(size) if model.kinds[i] == BYTE}
        self.byte_of = {i: b for b, i in self.bytes.items()}
        self.alone: np.ndarray | None = None
        self.merge_keys: np.ndarray | None = None
        # A lossy table of pairs seen: a pair that was pushed out is worked out again.
        self.pair_keys = np.full(1 << 20, _NONE, np.int64)
        self.pair_stable = np.zeros(1 << 20, bool)
        self.words: dict[str, bytes] = {}
        self.surface: list[bytes] | None = None

    def _compile_trie(self) -> None:
        characters = sorted({c for p in self.ids for c in p})
        self.classes = np.zeros(0x110000, np.int32)  # 0: in no piece
        self.classes[[ord(c) for c in characters]] = np.arange(1, len(characters) + 1)
        self.width = len(characters) + 1
        arcs: dict[int, int] = {}
        final = [_NONE]
        for piece, i in self.ids.items():
            state = 0
            for c in piece:
                key = state * self.width + int(self.classes[ord(c)])
                if key not in arcs:
                    arcs[key] = len(final)
                    final.append(_NONE)
                state = arcs[key]
            final[state] = i
        keys = np.array(sorted(arcs), np.int64)
        self.arc_keys = np.append(keys, np.iinfo(np.int64).max)
        self.arc_ends = np.array([arcs[k] for k in keys.tolist()] + [0], np.int64)
        self.final = np.array(final, np.int64)
        self.longest = max(map(len, self.ids), default=0)

    def _compile_cuts(self) -> None:
        """A pattern for stretches that no piece reaches out of."""
        several = [p for p in self.ids if len(p) > 1]
        glued = {c for p in several for c in p} - {SPACE}
        inside = any(SPACE in p.lstrip(SPACE) for p in several)
        letters = "".join(re.escape(c) for c in sorted(glued))
        if inside or not letters:
            self.cut = re.compile(f"[{letters}{SPACE}]+|.", re.DOTALL) if letters else re.compile(".", re.DOTALL)
        else:
            self.cut = re.compile(f"{SPACE}*[{letters}]+|{SPACE}+|.", re.DOTALL)

    def merged(self, text: str) -> list[str]:
        """What merging yields: the best scored pair first, of equal ones the leftmost."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, 0
            for i in range(len(parts) - 1):
                score = self.priority.get(parts[i] + parts[i + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _compile_merges(self) -> None:
        """Sorted pairs of tokens whose spelling joins to a piece, with that piece and its rank; spellings as tokens."""
        span = self.size + 0x110000
        token = {**{c: self.size + ord(c) for p in self.ids for c in p}, **self.ids}
        ranks = {score: k for k, score in enumerate(sorted(set(self.priority.values()), reverse=True))}
        merges: dict[int, tuple[int, int]] = {}
        for piece, i in self.ids.items():
            for cut in range(1, len(piece)):
                left, right = token.get(piece[:cut]), token.get(piece[cut:])
                if left is not None and right is not None:
                    merges[left * span + right] = (i, ranks[self.priority[piece]])
        keys = sorted(merges)
        self.merge_keys = np.array([*keys, np.iinfo(np.int64).max], np.int64)
        self.merge_to = np.array([merges[k] for k in keys] + [(0, 0)], np.int64)
        self.spelling = np.full((self.size, max(self.longest, 1)), _NONE, np.int64)
        self.letters = np.zeros(self.size, np.int64)
        for piece, i in self.ids.items():
            self.letters[i] = len(piece)
            self.spelling[i, : len(piece)] = [token[c] for c in piece]

    def _ranked(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(piece, rank) that two neighbours merge to; a rank beyond all others if they don't."""
        key = left * (self.size + 0x110000) + right
        at = np.searchsorted(self.merge_keys, key)
        hit = (self.merge_keys[at] == key) & (left >= 0) & (right >= 0)
        return np.where(hit, self.merge_to[at, 0], _NONE), np.where(hit, self.merge_to[at, 1], _NEVER)

    def _simulated(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """`merged` for many pairs at once: whether no merge crosses the border and both sides merge to one."""
        if self.merge_keys is None:
            self._compile_merges()
        known = [left < self.size, right < self.size]
        sizes = [np.where(k, self.letters[np.where(k, x, 0)], 1) for x, k in zip((left, right), known)]
        most = int((sizes[0] + sizes[1]).max()) + 1
        symbols = np.full((len(left), most), _NONE, np.int64)
        for x, k, size, shift in ((left, known[0], sizes[0], np.zeros_like(left)), (right, known[1], sizes[1], sizes[0])):
            spelled = np.where(k[:, None], self.spelling[np.where(k, x, 0)], _NONE)
            spelled[~k, 0] = x[~k]
            row, column = np.nonzero(np.arange(spelled.shape[1]) < size[:, None])
            symbols[row, column + shift[row]] = spelled[row, column]
        border = sizes[0].copy()  # symbols left of the border
        pieces, ranks = self._ranked(symbols[:, :-1], symbols[:, 1:])
        stable = np.zeros(len(left), bool)
        rows = np.arange(len(left))
        columns = np.arange(most)
        while len(rows):
            at = np.argmin(ranks, axis=1)
            line = np.arange(len(rows))
            over = ranks[line, at] == _NEVER
            stable[rows[over]] = (border[over] == 1) & (symbols[over, 1] >= 0) & (symbols[over, 2:] < 0).all(axis=1)
            go = ~over & (at != border - 1)
            rows, at, border = rows[go], at[go], border[go]
            symbols, pieces, ranks = symbols[go], pieces[go], ranks[go]
            if not len(rows):
                break
            line = np.arange(len(rows))
            symbols[line, at] = pieces[line, at]
            # What stands right of the merged pair moves up by one.
            move = np.minimum(columns + (columns > at[:, None]), most - 1)
            symbols = np.take_along_axis(symbols, move, axis=1)
            symbols[:, -1] = _NONE
            pair_move = np.minimum(columns[:-1] + (columns[:-1] > at[:, None]), most - 2)
            pieces, ranks = np.take_along_axis(pieces, pair_move, axis=1), np.take_along_axis(ranks, pair_move, axis=1)
            pieces[:, -1], ranks[:, -1] = _NONE, _NEVER
            for beside in (at - 1, at):
                there = np.flatnonzero((beside >= 0) & (beside < most - 1))
                c = beside[there]
                pieces[there, c], ranks[there, c] = self._ranked(symbols[there, c], symbols[there, c + 1])
            border = border - (at < border)
        return stable

    def _stable(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether merging left + right alone yields these two."""
        keys = left * (self.size + 0x110000) + right
        slots = ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(44)).astype(np.int64)
        known = self.pair_keys[slots] == keys
        out = self.pair_stable[slots] & known
        if not known.all():
            fresh, back = np.unique(keys[~known], return_inverse=True)
            answers = self._simulated(*np.divmod(fresh, self.size + 0x110000))
            out[~known] = answers[back]
            fresh_slots = ((fresh.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(44)).astype(np.int64)
            self.pair_keys[fresh_slots] = fresh
            # Two fresh pairs may share a slot: the table keeps the answer of the key that stayed.
            stayed = self.pair_keys[fresh_slots] == fresh
            self.pair_stable[fresh_slots[stayed]] = answers[stayed]
        return out

    def _own(self, tokens: np.ndarray) -> np.ndarray:
        """Whether merging the piece's own letters yields the piece."""
        if self.alone is None:
            self.alone = np.zeros(self.size, bool)
            for piece, i in self.ids.items():
                self.alone[i] = self.merged(piece) == [piece]
        return np.where(tokens < self.size, self.alone[np.minimum(tokens, self.size - 1)], True)

    def _arcs(self, codes: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, ...]:
        """The lattice: (word, start, length, token) of every arc."""
        classes = np.where(codes >= 0, self.classes[np.maximum(codes, 0)], _NONE)
        word, start = np.nonzero(codes >= 0)
        state = np.zeros(len(word), np.int64)
        found = []
        for size in range(1, self.longest + 1):
            inside = start + size <= lengths[word]
            word, start, state = word[inside], start[inside], state[inside]
            key = state * self.width + classes[word, start + size - 1]
            at = np.searchsorted(self.arc_keys, key)
            hit = self.arc_keys[at] == key
            word, start, state = word[hit], start[hit], self.arc_ends[at[hit]]
            token = self.final[state]
            ends = token >= 0
            found.append((word[ends], start[ends], np.full(int(ends.sum()), size), token[ends]))
            if size == 1:
                single = np.zeros(codes.shape, bool)
                single[word[ends], start[ends]] = True
                w, s = np.nonzero((codes >= 0) & ~single)
                found.append((w, s, np.ones(len(w), np.int64), self.size + codes[w, s].astype(np.int64)))
            if not len(word):
                break
        return tuple(np.concatenate(column) for column in zip(*found))

    def _paths(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The tokens on the path of least weight through the lattice of each word, one after the other, and where each begins."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        n, most = len(words), int(lengths.max())
        codes = np.full((n, most), _NONE, np.int32)
        flat = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.int32)
        codes[np.arange(most) < lengths[:, None]] = flat
        word, start, size, token = self._arcs(codes, lengths)
        order = np.argsort(start, kind="stable")
        word, start, size, token = word[order], start[order], size[order], token[order]
        borders = np.searchsorted(start, np.arange(most + 1))
        weight = np.full((n, most + 1), np.inf, np.float32)
        weight[:, 0] = 0
        last = np.full((n, most + 1), _NONE, np.int64)
        origin = np.zeros((n, most + 1), np.int64)
        for s in range(most):
            part = slice(borders[s], borders[s + 1])
            w, t, end = word[part], token[part], s + size[part]
            reached = weight[w, s] < np.inf
            w, t, end = w[reached], t[reached], end[reached]
            if self.model.type == UNIGRAM:
                cost = weight[w, s] + self.weights[np.minimum(t, self.size)]
                better = cost < weight[w, end]
            else:
                cost = np.zeros(len(w))
                better = self._own(t) if s == 0 else self._stable(last[w, s], t)
            w, t, end = w[better], t[better], end[better]
            weight[w, end], last[w, end], origin[w, end] = cost[better], t, s
        on_path = np.full((n, most), _NONE, np.int64)
        at, rows = lengths.copy(), np.arange(n)
        while len(rows := rows[at[rows] > 0]):
            here = at[rows]
            at[rows] = origin[rows, here]
            on_path[rows, at[rows]] = last[rows, here]
        kept = on_path >= 0
        return on_path[kept], np.concatenate(([0], np.cumsum(kept.sum(axis=1))))

    def _emit(self, tokens: np.ndarray) -> bytes:
        """Ids as bytes of 32-bit numbers; unknown characters become byte pieces or the unknown id."""
        ids: list[int] = []
        for t in tokens.tolist():
            if t < self.size:
                ids.append(t)
            elif self.model.byte_fallback:
                ids.extend(self.bytes[b] for b in chr(t - self.size).encode("utf-8", "surrogatepass"))
            else:
                ids.append(self.model.unknown)
        return np.array(ids, np.int32).tobytes()

    def encode_words(self, words: list[str]) -> dict[str, bytes]:
        """The ids of each word. Words are searched in groups of similar length, long ones a few at a time."""
        words = sorted(words, key=len)
        done: dict[str, bytes] = {}
        at = 0
        while at < len(words):
            # About as many cells in each group; the words of a group differ little in length.
            longest = len(words[min(at + 4_000, len(words)) - 1])
            step = 4_000 if longest <= _LONG else max(1, 250_000 // longest)
            group = words[at : at + step]
            if len(group[0]) * 4 < len(group[-1]):
                group = [w for w in group if len(w) <= max(16, len(group[0]) * 4)]
            tokens, borders = self._paths(group)
            data = tokens.astype(np.int32).tobytes()
            ends = (borders * 4).tolist()
            done.update(zip(group, (data[a:b] for a, b in zip(ends, ends[1:]))))
            unknown = np.unique(np.searchsorted(borders, np.flatnonzero(tokens >= self.size), side="right") - 1)
            for k in unknown.tolist():
                done[group[k]] = self._emit(tokens[borders[k] : borders[k + 1]])
            at += len(group)
        return done

    def encode(self, texts: list[str | None]) -> list[np.ndarray | None]:
        """Ids of each text."""
        cut = [None if t is None else self.cut.findall(self.normalise(t)) for t in texts]
        wanted = set(chain.from_iterable(c for c in cut if c))
        fresh = self.encode_words([w for w in wanted if w not in self.words])
        room = REMEMBERED - len(self.words)
        if room >= len(fresh):
            self.words.update(fresh)
            known = self.words
        else:
            known = {w: fresh[w] if w in fresh else self.words[w] for w in wanted}
        out: list[np.ndarray | None] = []
        for c in cut:
            if c is None:
                out.append(None)
                continue
            ids = np.frombuffer(b"".join(map(known.__getitem__, c)), np.int32)
            if not self.model.byte_fallback and len(ids):
                # Neighbouring unknown characters are one unknown piece.
                again = (ids == self.model.unknown) & (np.concatenate(([_NONE], ids[:-1])) == self.model.unknown)
                ids = ids[~again]
            out.append(ids)
        return out

    def decode(self, ids: np.ndarray) -> str:
        """The text of a sequence of ids; bytes that are no UTF-8 become U+FFFD, one each."""
        model = self.model
        if self.surface is None:
            names = {CONTROL: "", UNKNOWN: model.unknown_surface, UNUSED: ""}
            texts = [names.get(k, p).encode("utf-8", "surrogatepass") for p, k in zip(model.pieces, model.kinds)]
            self.surface = [bytes([self.byte_of[i]]) if i in self.byte_of else x for i, x in enumerate(texts)]
        # A piece begins with a whole character, so bytes that are no text stay none beside it.
        text = _each_bad_byte(b"".join(map(self.surface.__getitem__, ids.tolist())))
        if model.escape:
            text = text.replace(SPACE, " ")
        return text[1:] if model.dummy_prefix and text.startswith(" ") else text


def _each_bad_byte(data: bytes) -> str:
    done = []
    while True:
        try:
            return "".join(done) + data.decode()
        except UnicodeDecodeError as bad:
            done.append(data[: bad.start].decode() + "\ufffd")
            data = data[bad.start + 1 :]


# --- on DataFrames --------------------------------------------------------------------

_machines: dict[str, Machine] = {}


def machine(data: bytes) -> Machine:
    """The compiled model, one per worker and model file."""
    key = hashlib.sha256(data).hexdigest()
    if key not in _machines:
        _machines.clear()
        _machines[key] = Machine(data)
    return _machines[key]


def read_model(spark: SparkSession, path: str) -> bytes:
    """The bytes of a model file, by a path that Spark can read."""
    return bytes(spark.read.format("binaryFile").load(path).select("content").first()[0])


def _slices(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Pieces of the batches: what comes out of a piece is sent on before the next is looked at."""
    for batch in batches:
        for at in range(0, len(batch), SLICE):
            yield batch.slice(at, SLICE)


def _lists(found: list[np.ndarray | None]) -> pa.Array:
    sizes = [0 if x is None else len(x) for x in found]
    values = np.concatenate([x for x in found if x is not None] or [np.zeros(0, np.int32)])
    offsets = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
    absent = np.array([x is None for x in found], bool)
    return pa.ListArray.from_arrays(pa.array(offsets, mask=np.append(absent, False)), pa.array(values))


def encoder(spark: SparkSession, model: str):
    """A function from a text column to the column of its ids."""
    shared = spark.sparkContext.broadcast(read_model(spark, model))

    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        compiled = machine(shared.value)
        for part in _slices(batches):
            yield _lists(compiled.encode(part.to_pylist()))

    return encode


def decoder(spark: SparkSession, model: str):
    """A function from a column of ids to the column of their text."""
    shared = spark.sparkContext.broadcast(read_model(spark, model))

    @F.arrow_udf(T.StringType())
    def decode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        compiled = machine(shared.value)
        for part in _slices(batches):
            texts = []
            for at in range(len(part)):
                ids = part[at].values
                texts.append(None if ids is None else compiled.decode(ids.to_numpy(zero_copy_only=False)))
            yield pa.array(texts, pa.string())

    return decode


def encode_texts(docs: DataFrame, model: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """`docs` with the ids of each text."""
    return docs.withColumn(ids, encoder(docs.sparkSession, model)(F.col(text).cast("string")))


def decode_ids(rows: DataFrame, model: str, ids: str = "ids", text: str = "text") -> DataFrame:
    """`rows` with the text of each sequence of ids."""
    return rows.withColumn(text, decoder(rows.sparkSession, model)(F.col(ids)))


def round_trip(docs: DataFrame, model: str, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, ids, n_ids, same): the ids of each text, and whether decoding them gives the text back.

    Both ways in one function, so that a worker compiles the model once and the ids are not sent twice.
    """
    shared = docs.sparkSession.sparkContext.broadcast(read_model(docs.sparkSession, model))
    kind = T.StructType([T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("same", T.BooleanType())])

    @F.arrow_udf(kind)
    def both(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        compiled = machine(shared.value)
        for part in _slices(batches):
            texts = part.to_pylist()
            found = compiled.encode(texts)
            same = [t is None if x is None else compiled.decode(x) == t for t, x in zip(texts, found)]
            yield pa.StructArray.from_arrays([_lists(found), pa.array(same, pa.bool_())], ["ids", "same"])

    rows = docs.select(F.col(id_column), both(F.col(text).cast("string")).alias("__found"))
    return rows.select(
        id_column, "__found.ids", F.size("__found.ids").cast("long").alias("n_ids"), F.col("__found.same").alias("same")
    )
