r"""Secret scans, with the ownership frequency of every candidate over the whole corpus.

Three base kinds are always reported: assignments of a value to a telling
name, access keys and long hexadecimal runs. Beside them the scan collects candidates of wider kinds: bearer
tokens, prefixed provider tokens, web tokens in three parts, passwords in URLs and
unnamed long runs of mixed letters and digits. A wide pattern also hits samples that everybody copies. So each
candidate value is hashed, and for each hash the distinct repositories and distinct
owners that hold it are counted. Both decide: a value that `EXAMPLE_OWNERS` owners or more hold, in `EXAMPLE_REPOSITORIES`
repositories or more, is a widely copied example and its spans are not reported. Any other looks like a live credential: one owner's own,
in however many repositories, or one that got from a leak into a few repositories of several owners. The same counts
label the base spans, which stay in either case, and are returned with every span.

A wider span that a reported span holds whole says nothing new and is left out; one that is overlapped in part is reported, so that no part of
a credential is passed over.

Everything is DataFrame functions: patterns are marked inside the text with a character that no pattern holds,
the marked text is cut there, and the lengths of the pieces give the positions, in code points.

Defined results: a null text counts as empty; rows are scanned one by one, repeated rows each give
their spans but count as one repository and one owner; rows without an owner share one unnamed
owner; empty tables give empty results; columns of the result replace columns of the same name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coratia.plans.lineage import store

# Patterns of the base kinds, in the order in which spans are listed.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
LEAST_ASSIGN, LEAST_ACCESS, LEAST_HEX = 8, 16, 32
BASE_KINDS = ["assign", "access", "hex"]

# Patterns of the wider kinds. Group 1 is the value where there is one.
WIDE = {
    "bearer": r"[Bb]earer\x20+([A-Za-z0-9._~+/-]{20,}=*)",
    "provider": r"((?:gh[pousr]_|glpat-|xox[abprs]-|sk_live_|SG\.)[A-Za-z0-9_.-]{16,})",
    "web_token": r"(eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,})",
    "url_password": r"://[A-Za-z0-9._~-]+:([A-Za-z0-9._~!-]{6,})@",
    "mixed": r"([A-Za-z0-9+/_-]{24,})",
}
KINDS = [*BASE_KINDS, *WIDE]
# From this many owners and this many repositories on a value is a widely copied example.
EXAMPLE_OWNERS, EXAMPLE_REPOSITORIES = 3, 10

_MARK, _OTHER = "\ufdd0", "\ufdd1"  # two code points that Unicode reserves for internal use


# Pieces gone through together; an even number.
_BLOCK = 1_000


def _pieces(text: Column, pattern: str, marked: Column) -> Column:
    """Text outside and inside the matches in turns, beginning outside; no match: the whole text."""
    wrapped = F.regexp_replace(marked, pattern, f"{_MARK}$0{_MARK}")
    return F.split(wrapped, _MARK, -1)


def _spans(pieces: Column, keep: str, rank: int, value: str) -> Column:
    """Array of (start, rank, stop, value) of the matches whose piece `p` satisfies the SQL condition `keep`."""
    # Every second piece is a match. Pieces are gone through in blocks, which begin outside a match: what is found
    # in a block is added to what was found before once, so a text of very many matches is not copied for each.
    empty = "cast(array() as array<struct<start: long, rank: int, stop: long, value: string>>)"
    span = f"named_struct('start', t.at, 'rank', {rank}, 'stop', t.at + length(p), 'value', {value})"
    block = (
        f"aggregate(slice({pieces}, b * {_BLOCK} + 1, {_BLOCK}), named_struct('at', s.at, 'inside', false, 'found', {empty}),"
        f" (t, p) -> named_struct('at', t.at + length(p), 'inside', not t.inside, 'found',"
        f" if(t.inside and ({keep}), concat(t.found, array({span})), t.found)),"
        " t -> named_struct('at', t.at, 'found', if(size(t.found) = 0, s.found, concat(s.found, t.found))))"
    )
    return F.expr(
        f"aggregate(sequence(0, cast((size({pieces}) - 1) div {_BLOCK} as int)), named_struct('at', 0L, 'found', {empty}),"
        f" (s, b) -> {block}, s -> s.found)"
    )


def _quoted(pattern: str) -> str:
    return "r'" + pattern.replace("'", r"\x27") + "'"


def _with_pieces(docs: DataFrame, text: str) -> DataFrame:
    """Adds the pieces of each kind, null where there is no match worth cutting for."""
    clean = F.translate(F.coalesce(F.col(text), F.lit("")), _MARK, _OTHER)
    docs = docs.withColumn("__clean", clean)
    # A quick look first: most texts hold none of the kinds, and a text without a match is not rewritten.
    # Runs of hexadecimal digits are everywhere in prose, so that kind looks only for long ones. The longest
    # run is the match in either case.
    patterns = {
        "assign": ASSIGN,
        "access": ACCESS[:-1] + f"{{{LEAST_ACCESS - 4},}}",
        "hex": HEX[:-1] + f"{{{LEAST_HEX},}}",
        **WIDE,
    }
    return docs.withColumns(
        {
            f"__{kind}": F.when(F.col("__clean").rlike(p), _pieces(F.col("__clean"), p, F.col("__clean")))
            for kind, p in patterns.items()
        }
    )


def _found(docs: DataFrame) -> DataFrame:
    """Adds __base and __wide, arrays of spans, and drops the text and its pieces."""
    value = f"regexp_extract(p, {_quoted(ASSIGN)}, 2)"
    columns = [_spans("coalesce(__assign, array(''))", f"length({value}) >= {LEAST_ASSIGN}", 0, value)]
    columns.append(_spans("coalesce(__access, array(''))", "true", 1, "p"))
    columns.append(_spans("coalesce(__hex, array(''))", "true", 2, "p"))
    wide = []
    for rank, (kind, pattern) in enumerate(WIDE.items(), len(BASE_KINDS)):
        inner = f"regexp_extract(p, {_quoted(pattern)}, 1)"
        keep = "p rlike '[0-9]' and p rlike '[a-z]' and p rlike '[A-Z]'" if kind == "mixed" else "true"
        wide.append(_spans(f"coalesce(__{kind}, array(''))", keep, rank, inner))
    base = F.array_sort(F.concat(*columns))
    docs = docs.withColumn("__base", base).withColumn("__some", F.array_sort(F.concat(*wide)))
    # A wider span that a base span holds whole says nothing new.
    free = F.expr("filter(__some, w -> not exists(__base, b -> b.start <= w.start and w.stop <= b.stop))")
    return docs.withColumn("__wide", free).drop("__some", "__clean", *[f"__{k}" for k in KINDS])


def ownership(values: DataFrame) -> DataFrame:
    """(hash, repositories, owners) of (hash, repository, owner): distinct counts, combined before they are shuffled.

    A value that a third of all rows hold is spread over its repositories and owners first; what meets
    at the hash is one count per task.
    """
    repositories = values.select("hash", "repository").distinct().groupBy("hash").agg(F.count(F.lit(1)).alias("repositories"))
    owners = values.select("hash", "owner").distinct().groupBy("hash").agg(F.count(F.lit(1)).alias("owners"))
    return repositories.join(owners, "hash")


def _listed(spans: str) -> Column:
    """kind:start:end of an array of spans, in its order, comma-joined."""
    kinds = "array(" + ", ".join(f"'{k}'" for k in KINDS) + ")"
    return F.expr(
        f"array_join(transform({spans}, s -> {kinds}[s.rank] || ':' || cast(s.start as string) || ':' || cast(s.stop as string)), ',')"
    )


_SPAN = "array<struct<start: long, rank: int, stop: long, value: string, repositories: long, owners: long>>"


def _scanned(
    docs: DataFrame, text: str, repository: str, owner: str, example_owners: int, example_repositories: int, carry: list[str]
) -> DataFrame:
    """__carry, a struct of the columns `carry`, and the spans found in each row, with the counts of their values."""
    rows = docs.select(
        F.struct(*carry).alias("__carry"),
        F.col(repository).cast("string").alias("__repository"),
        F.col(owner).cast("string").alias("__owner"),
        F.col(text).alias("__text"),
    )
    found = _found(_with_pieces(rows, "__text")).drop("__text")
    # The text is read once: from here on only what was found is looked at.
    found = store(found.withColumn("__row", F.monotonically_increasing_id()), "found").df
    some = found.filter((F.size("__base") > 0) | (F.size("__wide") > 0))
    values = some.select(
        "__row",
        F.coalesce("__repository", F.lit("")).alias("repository"),
        F.coalesce("__owner", F.lit("")).alias("owner"),
        F.explode(F.concat("__base", "__wide")).alias("span"),
    ).withColumn("hash", F.sha2("span.value", 256))
    # Most values stand in one repository; the counts of the others are joined.
    held = store(ownership(values).filter("repositories > 1"), "held")
    counted = values.join(held.sized(), "hash", "left").select(
        "__row",
        F.struct(
            "span.*", F.coalesce("repositories", F.lit(1)).alias("repositories"), F.coalesce("owners", F.lit(1)).alias("owners")
        ).alias("span"),
    )
    spans = store(counted.groupBy("__row").agg(F.array_sort(F.collect_list("span")).alias("__spans")), "spans")
    none = F.array().cast(_SPAN)
    joined = found.select("__row", "__carry").join(spans.sized(), "__row", "left").withColumn("__spans", F.coalesce("__spans", none))
    last = len(BASE_KINDS) - 1
    example = f"(s.owners >= {example_owners} and s.repositories >= {example_repositories})"
    live = joined.withColumn("__live", F.expr(f"filter(__spans, s -> s.rank > {last} and not {example})"))
    # Of a live span inside another live one of an earlier kind the outer one is enough.
    outer = F.expr("filter(__live, w -> not exists(__live, v -> v.rank < w.rank and v.start <= w.start and w.stop <= v.stop))")
    return live.select(
        "__carry",
        F.expr(f"filter(__spans, s -> s.rank <= {last})").alias("base"),
        outer.alias("wide"),
        F.expr(f"array_distinct(transform(filter(__spans, s -> {example}), s -> s.value))").alias("examples"),
    )


def scan(
    docs: DataFrame,
    text: str = "text",
    repository: str = "doc_id",
    owner: str = "source",
    example_owners: int = EXAMPLE_OWNERS,
    carry: list[str] | None = None,
    example_repositories: int = EXAMPLE_REPOSITORIES,
) -> DataFrame:
    """Columns `carry` (default: the repository) of `docs`, with the spans found in each row.

    base: array of (start, rank, stop, value, repositories, owners) of the base kinds; wide: those of the wider kinds that
    look live; examples: values, of any kind, that as many owners and repositories hold as make an example.
    """
    found = _scanned(docs, text, repository, owner, example_owners, example_repositories, [repository] if carry is None else carry)
    own = [c for c in (carry or [repository]) if c not in ("base", "wide", "examples")]
    return found.select(*[F.col(f"__carry.{c}").alias(c) for c in own], "base", "wide", "examples")


def digest(scanned: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """The columns of the query: counts, the hash of the base spans, all spans, the repositories and owners that hold the value of each, and
    how many are examples."""

    def count(rank: int) -> Column:
        return F.expr(f"size(filter(base, s -> s.rank = {rank}))").cast("long")

    every = scanned.withColumn("__all", F.array_sort(F.concat("base", "wide")))
    return every.select(
        id_column,
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(_listed("base"), 256).alias("base_sha256"),
        _listed("__all").alias("spans"),
        F.expr(
            "array_join(transform(__all, s -> cast(s.repositories as string) || ':' || cast(s.owners as string)), ',')"
        ).alias("holders"),
        F.expr("size(filter(__all, s -> array_contains(examples, s.value)))").cast("long").alias("n_examples"),
        F.expr("size(filter(__all, s -> not array_contains(examples, s.value)))").cast("long").alias("n_live"),
    )


def redacted(text: Column, spans: Column) -> Column:
    """`text` with every reported span replaced by [kind]; of overlapping spans the union is replaced, under the first kind."""
    piece = F.aggregate(
        spans,
        F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("done")),
        lambda s, x: F.struct(
            F.greatest(s["at"], x["stop"]).alias("at"),
            F.when(
                x["start"] >= s["at"],
                F.concat(
                    s["done"],
                    F.substring(text, (s["at"] + 1).cast("int"), (x["start"] - s["at"]).cast("int")),
                    F.lit("["),
                    F.element_at(F.array(*[F.lit(k) for k in KINDS]), x["rank"] + 1),
                    F.lit("]"),
                ),
            )
            .otherwise(s["done"])
            .alias("done"),
        ),
        lambda s: F.concat(s["done"], F.substring(text, (s["at"] + 1).cast("int"), F.lit(2147483647))),
    )
    return F.when(F.size(spans) > 0, piece).otherwise(text)


def redact(
    docs: DataFrame,
    text: str = "text",
    repository: str = "doc_id",
    owner: str = "source",
    example_owners: int = EXAMPLE_OWNERS,
    example_repositories: int = EXAMPLE_REPOSITORIES,
) -> DataFrame:
    """`docs`, all rows and columns, with the secrets in the text blanked out: base spans, and wider ones that look live."""
    scanned = _scanned(docs, text, repository, owner, example_owners, example_repositories, docs.columns)
    spans = F.array_sort(F.concat("base", "wide"))
    return scanned.select(
        *[(redacted(F.col(f"__carry.{c}"), spans) if c == text else F.col(f"__carry.{c}")).alias(c) for c in docs.columns]
    )
