"""Language identification with hyperdimensional profiles.

Every letter has a random vector of `DIMENSIONS` components +1 or -1, made from its code
point. A run of three characters is bound into one vector: the letters' vectors are
rotated by two, one and no places and multiplied. A text's vector is the sum (the bundle) over its runs,
a language's prototype the sum over its training texts. A text gets the language whose prototype
has the largest cosine with it.

Texts are lower-cased; everything between letters is one space, which has a vector too.

Since bundling is a sum, a vector is the counts of the distinct runs times their
vectors. Training ships counts of runs per language, combined in the tasks; run
vectors are made once per worker and kept up to a fixed number.

Defined results: `und` with score 0 for a null text or one without a letter, and for every text if there is
nothing to learn from; of languages with equal cosine the first by code point; rows
are judged one by one, whatever other rows or columns there are; an empty table gives an empty
result. A row without an id counts as held out if the hash of the empty text says so. Columns of the
result replace columns of the same name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

DIMENSIONS = 1024
RUN = 3
SEED = 7
UNKNOWN = "und"
# Training reads about this many labelled texts at most, chosen by a hash of their ids.
TRAINING_TEXTS = 20_000
# Of a language about so many are read in any case, however many languages there are.
FEWEST_TEXTS = 32
# Run vectors kept per worker.
KEPT_RUNS = 60_000
_BITS = 21  # a code point
_MOST_RUNS = 3_000  # distinct runs summed at once
SLICE = 64  # texts judged together


class Space:
    """The vectors of letters and runs."""

    def __init__(self, dimensions: int = DIMENSIONS, seed: int = SEED):
        self.dimensions, self.seed = dimensions, seed
        self.letters: dict[int, np.ndarray] = {}
        self.place: dict[int, int] = {}
        self.vectors = np.zeros((1024, dimensions), np.float32)

    def letter(self, point: int) -> np.ndarray:
        if point not in self.letters:
            digest = hashlib.shake_128(f"{self.seed}:{point}".encode()).digest(self.dimensions // 8)
            bits = np.unpackbits(np.frombuffer(digest, np.uint8))
            self.letters[point] = bits.astype(np.float32) * 2 - 1
        return self.letters[point]

    def run(self, code: int) -> np.ndarray:
        """The bound vector of a run of characters packed into one number."""
        mask = (1 << _BITS) - 1
        bound = self.letter(code & mask)
        for shift in range(1, RUN):
            bound = bound * np.roll(self.letter((code >> (shift * _BITS)) & mask), shift)
        return bound

    def matrix(self, codes: np.ndarray) -> np.ndarray:
        """One row per run."""
        fresh = [c for c in codes.tolist() if c not in self.place]
        if len(self.place) + len(fresh) > KEPT_RUNS:
            if len(codes) > KEPT_RUNS:
                raise ValueError("too many runs at once")
            self.place.clear()
            fresh = codes.tolist()
        while len(self.vectors) < len(self.place) + len(fresh):
            self.vectors = np.concatenate([self.vectors, np.zeros_like(self.vectors)])
        for code in fresh:
            at = self.place[code] = len(self.place)
            self.vectors[at] = self.run(code)
        return self.vectors[np.fromiter(map(self.place.__getitem__, codes.tolist()), np.int64, len(codes))]

    def bundles(self, texts: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """One bundle per (codes, counts). Sums of whole numbers, so exact whatever they are summed with."""
        total = np.zeros((len(texts), self.dimensions))
        if not texts:
            return total
        owner = np.repeat(np.arange(len(texts)), [len(codes) for codes, _ in texts])
        codes, place = np.unique(np.concatenate([codes for codes, _ in texts]), return_inverse=True)
        counts = np.concatenate([counts for _, counts in texts])
        for at in range(0, len(codes), _MOST_RUNS):
            part = codes[at : at + _MOST_RUNS]
            here = (place >= at) & (place < at + len(part))
            table = np.zeros((len(texts), len(part)), np.float32)
            table[owner[here], place[here] - at] = counts[here]
            total += table @ self.matrix(part)
        return total


_tables: list[np.ndarray] = []
_spaces: dict[tuple[int, int], Space] = {}


def _lower_table() -> np.ndarray:
    """Per code point: that of its lower-case letter, or a space if it is no letter."""
    if not _tables:
        table = np.full(0x110000, 32, np.int64)
        for point in range(0x110000):
            c = chr(point)
            if c.isalpha():
                table[point] = ord(c.lower()[0])
        _tables.append(table)
    return _tables[0]


def _space(dimensions: int, seed: int) -> Space:
    if (dimensions, seed) not in _spaces:
        _spaces[dimensions, seed] = Space(dimensions, seed)
    return _spaces[dimensions, seed]


def run_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct runs of three characters, packed, and their counts; none for a text without a letter.

    A text is taken to stand between spaces.
    """
    points = np.frombuffer(f" {text} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    letters = _lower_table()[points]
    spaces = letters == 32
    letters = letters[~(spaces & np.concatenate(([False], spaces[:-1])))]
    if len(letters) < RUN:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    packed = letters[: 1 - RUN]
    for shift in range(1, RUN):
        packed = (packed << _BITS) | letters[shift : len(letters) - RUN + 1 + shift]
    return np.unique(packed, return_counts=True)


@dataclass(frozen=True)
class Prototypes:
    languages: tuple[str, ...]
    vectors: np.ndarray  # one row of length 1 per language
    dimensions: int = DIMENSIONS
    seed: int = SEED

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        counted = [run_counts(t or "") for t in texts]
        bundles = _space(self.dimensions, self.seed).bundles(counted)
        found = []
        for (codes, _), bundle in zip(counted, bundles):
            if not len(codes) or not len(self.languages):
                found.append((UNKNOWN, 0.0))
                continue
            length = float(np.sqrt(bundle @ bundle))
            cosines = self.vectors @ bundle / length if length else np.zeros(len(self.languages))
            # Equal prototypes may come out unequal in the last digits.
            best = int(np.argmax(np.round(cosines, 12)))
            found.append((self.languages[best], float(min(1.0, max(0.0, cosines[best])))))
        return found


def held_out(id_column: str | Column) -> Column:
    """Whether crc32 of the id as text leaves 2 when divided by 4."""
    column = F.col(id_column) if isinstance(id_column, str) else id_column
    return F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def sampling_rates(available: dict[str, int], most: int) -> dict[str, float]:
    """The share of each language's texts to read, so that about `most` are read and no language misses out."""
    rates, left = {}, float(most)
    for at, (lang, count) in enumerate(sorted(available.items(), key=lambda x: (x[1], x[0]))):
        part = min(float(count), max(left / (len(available) - at), FEWEST_TEXTS))
        rates[lang] = part / count
        left -= part
    return rates


def learn(
    labelled: DataFrame,
    id_column: str = "doc_id",
    text: str = "text",
    lang: str = "lang",
    most: int = TRAINING_TEXTS,
    dimensions: int = DIMENSIONS,
    seed: int = SEED,
) -> Prototypes:
    """Prototypes of the labelled texts; rows without text or language teach nothing.

    About `most` texts are read: as many of each language as of any other, all of those that have fewer. Which
    ones, a hash of id and text decides, so repeated or missing ids do not come or go together.
    """
    rows = labelled.select(
        F.col(id_column).cast("string").alias("id"), F.col(lang).cast("string").alias("lang"), F.col(text).alias("text")
    ).filter("lang is not null and text is not null")
    # One number per language; as many vectors come back in the end.
    available = {row["lang"]: row["count"] for row in rows.groupBy("lang").count().collect()}
    if sum(available.values()) > most:
        rates = sampling_rates(available, most)
        rate = F.element_at(F.create_map(*[F.lit(x) for pair in rates.items() for x in pair]), F.col("lang"))
        rows = rows.filter(F.shiftrightunsigned(F.xxhash64("id", "text"), 11) / F.lit(float(1 << 53)) < rate)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[tuple[str, int], int] = {}

        def flush() -> pa.RecordBatch:
            keys = list(totals)
            batch = pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int64()), pa.array(list(totals.values()), pa.int64())],
                ["lang", "run", "n"],
            )
            totals.clear()
            return batch

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                for name, body in zip(part.column("lang").to_pylist(), part.column("text").to_pylist()):
                    codes, counts = run_counts(body)
                    for code, count in zip(codes.tolist(), counts.tolist()):
                        totals[name, code] = totals.get((name, code), 0) + count
                if len(totals) > 500_000:
                    yield flush()
        yield flush()

    schema = "lang string, run long, n long"
    summed = rows.select("lang", "text").mapInArrow(counted, schema).groupBy("lang", "run").agg(F.sum("n").alias("n"))

    def bundled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        space, totals = Space(dimensions, seed), {}
        for batch in batches:
            frame = pd.DataFrame({c: batch.column(c).to_pandas() for c in ("lang", "run", "n")})
            for name, part in frame.groupby("lang"):
                vector = space.bundles([(part["run"].to_numpy(), part["n"].to_numpy())])[0]
                totals[name] = totals.get(name, 0) + vector
        for name, vector in totals.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([name]), pa.array([vector.tolist()], pa.list_(pa.float64()))], ["lang", "vector"]
            )

    # One vector per language and task comes back.
    totals: dict[str, np.ndarray] = {}
    for row in summed.mapInArrow(bundled, "lang string, vector array<double>").collect():
        totals[row["lang"]] = totals.get(row["lang"], 0) + np.array(row["vector"])
    names = tuple(sorted(n for n, v in totals.items() if np.any(v)))
    vectors = np.stack([totals[n] / np.sqrt(totals[n] @ totals[n]) for n in names]) if names else np.zeros((0, dimensions))
    return Prototypes(names, vectors, dimensions, seed)


def predictor(model: Prototypes):
    """A function from a text column to a struct (lang_pred, score)."""

    @F.pandas_udf(T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]))
    def predict(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for series in texts:
            texts = series.tolist()
            found = [p for at in range(0, len(texts), SLICE) for p in model.predict(texts[at : at + SLICE])]
            yield pd.DataFrame(found, columns=["lang_pred", "score"])

    return predict


def identify(
    docs: DataFrame, id_column: str = "doc_id", text: str = "text", lang: str = "lang", most: int = TRAINING_TEXTS
) -> DataFrame:
    """(id, held_out, lang_pred, score): learnt from the rows that are not held out, predicted for all rows."""
    model = learn(docs.filter(~held_out(id_column)), id_column, text, lang, most)
    told = docs.select(
        F.col(id_column), held_out(id_column).alias("held_out"), predictor(model)(F.col(text).cast("string")).alias("__p")
    )
    return told.select(id_column, "held_out", "__p.lang_pred", "__p.score")
