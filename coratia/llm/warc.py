r"""WARC archives of pages, read back into globally ordered capture histories.

Writing: each page becomes one record. Of the pages with equal payloads the one with the smallest id is a
response, the others are revisits of it: they keep the HTTP header, which tells the length of the full payload,
but not the payload. Records are text, so Spark's text writer makes the files: its
line separator is the pair of line breaks that ends a record. Files are of bounded size, uncompressed, and a record can be
fetched by its offset.

Reading: archives come back whole, one at a time, and are cut by the lengths in their headers; payloads are hashed
again and compared with the stated digest.

Index: the captures of each reading task are sorted into a run by URL key (host reversed, so
that a domain lies together), time and id. Runs are cut at common borders of key ranges, and each range merges
its pieces of all runs with a loser tree, so that the ranges one after the other hold all captures in order. The
borders are taken over the whole key, so a URL with very many captures is spread over ranges.

Defined results: a null page is an empty payload; empty payloads are equal like others. Rows
that repeat an id and a payload are one response and revisits. A page without an id comes after those with
one; its revisits refer to null. A null URL is an empty one; line breaks in a URL are
written as %0D and %0A. Empty tables give empty results. Other columns are not looked at.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from coratia.plans.lineage import fresh_path, store

ARCHIVE_BYTES = 16 << 20
LEAST_SHARED = 0  # shorter payloads are never revisits
CAPTURES_PER_RANGE = 200_000

_BREAK = "\r\n"
_END = _BREAK * 2
_DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_ID = "urn:x-page:"


# --- writing --------------------------------------------------------------------------


def base32(hexadecimal: Column) -> Column:
    """160 bits in 40 hexadecimal digits as 32 digits of base 32: five digits of one are four of the other."""
    pieces = []
    for group in range(8):
        number = F.conv(F.substring(hexadecimal, group * 5 + 1, 5), 16, 10).cast("int")
        for shift in (15, 10, 5, 0):
            place = F.shiftright(number, shift).bitwiseAND(F.lit(31)) + 1
            pieces.append(F.substring(F.lit(_DIGITS), place, F.lit(1)))
    return F.concat(*pieces)


def capture_time(page_id: Column) -> Column:
    """The pages have no time of capture: each is taken a second after the page with the id before it."""
    second = F.pmod(F.coalesce(page_id, F.lit(0)), F.lit(1_000_000_000)).cast("decimal(18,6)")
    moment = F.to_timestamp_ntz(F.lit("2024-01-01 00:00:00")) + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), second)
    return F.date_format(moment, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def _typed(pages: DataFrame, least_shared: int) -> DataFrame:
    """(page_id, url, html, digest, size, first_id, response) per row of (page_id, url, html)."""
    data = F.col("html").cast("binary")
    pages = pages.withColumns({"digest": base32(F.sha1(data)), "size": F.octet_length(data).cast("long")})
    same = ["digest", "size"]
    ids = store(pages.groupBy(*same, "page_id").agg(F.count(F.lit(1)).alias("n")), "payloads")
    order = F.struct(F.col("page_id").isNull().alias("absent"), "page_id")
    firsts = store(ids.df.groupBy(*same).agg(F.min(order).alias("first")), "firsts")
    firsts_only = firsts.df.select(*same, F.col("first.page_id").alias("first_id"))
    joined = pages.join(firsts.fits(firsts_only), same)
    own = F.col("page_id").eqNullSafe(F.col("first_id"))
    joined = joined.withColumn("response", own | (F.col("size") < least_shared))
    again = store(
        ids.df.filter("n > 1").join(firsts.fits(firsts_only), same).filter(own).select(*same, F.lit(True).alias("again")),
        "again",
    )
    if again.rows == 0:
        return joined
    # Rows that repeat the id and payload of a response: counted, and one of them is the response.
    marked = joined.join(again.sized(), same, "left")
    several = F.coalesce(F.col("again"), F.lit(False)) & own & (F.col("size") >= least_shared)
    counted = (
        marked.filter(several)
        .groupBy("page_id", *same, "first_id", "url")
        .agg(F.count(F.lit(1)).alias("n"), F.min("html").alias("html"))
    )
    least = store(counted.groupBy(*same).agg(F.min("url").alias("least_url")), "least")
    spread = (
        counted.join(least.sized(), same)
        .withColumn("k", F.explode(F.sequence(F.lit(1), F.col("n"))))
        .withColumn("response", (F.col("k") == 1) & (F.col("url") == F.col("least_url")))
    )
    return marked.filter(~several).select(*joined.columns).unionByName(spread.select(*joined.columns))


def records(pages: DataFrame, least_shared: int = LEAST_SHARED) -> DataFrame:
    """One column `value`: a whole WARC record, without the line breaks that end it."""
    url = F.replace(F.replace(F.coalesce("url", F.lit("")), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    rows = _typed(
        pages.select(F.col("page_id").cast("long").alias("page_id"), url.alias("url"), F.coalesce("html", F.lit("")).alias("html")),
        least_shared,
    )

    def named(page: str) -> Column:
        return F.concat(F.lit(f"<{_ID}"), F.coalesce(F.col(page).cast("string"), F.lit("")), F.lit(">"))

    http = F.concat(
        F.lit(f"HTTP/1.1 200 OK{_BREAK}Content-Type: text/html; charset=utf-8{_BREAK}Content-Length: "),
        F.col("size").cast("string"),
        F.lit(_END),
    )
    block = F.when(F.col("response"), F.concat(http, "html")).otherwise(http)
    lines = [
        F.lit("WARC/1.1"),
        F.when(F.col("response"), F.lit("WARC-Type: response")).otherwise(F.lit("WARC-Type: revisit")),
        F.concat(F.lit("WARC-Record-ID: "), named("page_id")),
        F.concat(F.lit("WARC-Target-URI: "), "url"),
        F.concat(F.lit("WARC-Date: "), capture_time(F.col("page_id"))),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), "digest"),
        # concat_ws leaves out what is null.
        F.when(~F.col("response"), F.concat(F.lit("WARC-Refers-To: "), named("first_id"))),
        F.when(~F.col("response"), F.lit(f"WARC-Profile: {_PROFILE}")),
        F.lit("Content-Type: application/http; msgtype=response"),
        F.concat(F.lit("Content-Length: "), F.octet_length("__block").cast("string")),
    ]
    head = F.concat_ws(_BREAK, *lines)
    return rows.withColumn("__block", block).select(F.concat(head, F.lit(_END), "__block").alias("value"))


def write_archives(pages: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> None:
    """Archives of about `archive_bytes`, however many rows and bytes there are."""
    long = pages.agg(F.avg(F.octet_length(F.coalesce("html", F.lit(""))))).first()[0] or 0
    per_file = max(1, int(archive_bytes / (long + 600)))
    (
        records(pages)
        .write.option("lineSep", _END)
        .option("maxRecordsPerFile", per_file)
        .text(folder)
    )


# --- reading --------------------------------------------------------------------------

_CAPTURE = (
    "file string, offset long, length long, record_type string, page_id long, uri string, captured_at string, "
    "payload_bytes long, payload_digest string, refers_to long"
)


def _headers(block: bytes) -> dict[str, str]:
    lines = block.decode("utf-8", "replace").split(_BREAK)
    return {name.lower(): value.strip() for name, _, value in (line.partition(":") for line in lines[1:])}


def _page(name: str) -> int | None:
    digits = name.removeprefix(f"<{_ID}").removesuffix(">")
    return int(digits) if digits else None


def parse(content: bytes) -> Iterator[tuple]:
    """(offset, length, type, page, uri, date, payload bytes, digest, page referred to) of each record of an archive."""
    at, end = 0, _END.encode()
    while at < len(content):
        if not content.startswith(b"WARC/1.", at):
            raise ValueError(f"no WARC record at byte {at}")
        stop = content.index(end, at)
        head = _headers(content[at:stop])
        body = stop + len(end)
        after = body + int(head["content-length"])
        if content[after : after + len(end)] != end:
            raise ValueError(f"the record at byte {at} does not end where its length says")
        payload = content.index(end, body) + len(end)
        kind, digest = head["warc-type"], head["warc-payload-digest"].removeprefix("sha1:")
        if kind == "revisit":
            size = int(_headers(content[body : payload - len(end)])["content-length"])
        else:
            size = after - payload
            if base64.b32encode(hashlib.sha1(content[payload:after]).digest()).decode() != digest:
                raise ValueError(f"the payload at byte {at} does not fit its digest")
        refers = head.get("warc-refers-to")
        yield (
            at, after - at, kind, _page(head["warc-record-id"]), head["warc-target-uri"], head["warc-date"],
            size, digest, None if refers is None else _page(refers),
        )
        at = after + len(end)


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """One row per record of the archives in a folder."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in _CAPTURE.split(", ")]
        types = [pa.string() if f.endswith("string") else pa.int64() for f in _CAPTURE.split(", ")]
        for batch in batches:
            for k in range(batch.num_rows):
                file = batch.column(0)[k].as_py().rsplit("/", 1)[-1]
                rows = [(file, *r) for r in parse(batch.column(1)[k].as_py())]
                for at in range(0, len(rows), 10_000):
                    columns = zip(*rows[at : at + 10_000])
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)

    return spark.read.format("binaryFile").load(folder).select("path", "content").mapInArrow(cut, _CAPTURE)


# --- the index ------------------------------------------------------------------------


def url_key(uri: Column) -> Column:
    """Host reversed by its labels, without `www`, user and port, then `)` and the path and query; others as they are."""
    scheme = r"^[A-Za-z][A-Za-z0-9+.-]*://"
    host = F.lower(F.regexp_extract(uri, scheme + r"(?:[^@/?#]*@)?(?:www[0-9]*\.)?([^/:?#]*)", 1))
    rest = F.regexp_extract(uri, scheme + r"[^/?#]*([^#]*)", 1)
    key = F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), F.when(rest == "", "/").otherwise(rest))
    return F.when(uri.rlike(scheme), key).otherwise(uri)


class LoserTree:
    """Merges sorted runs. Each inner node holds the loser of its match; the winner of all is on top.

    After the winner is taken only the matches on its way up are played again:
    about log2(runs) comparisons per item.
    """

    def __init__(self, runs: list[Iterator]):
        self.runs = runs
        self.heads = [next(r, None) for r in runs]
        self.size = max(1, len(runs))
        self.losers = [-1] * self.size
        for run in range(len(runs)):
            self._play(run)

    def _beats(self, a: int, b: int) -> bool:
        """Run a's head comes before run b's; an empty run loses, of equal heads the first run wins."""
        if self.heads[a] is None or self.heads[b] is None:
            return self.heads[b] is None and (self.heads[a] is not None or a < b)
        return self.heads[a] < self.heads[b] or (self.heads[a] == self.heads[b] and a < b)

    def _play(self, run: int) -> None:
        winner, node = run, (run + self.size) // 2
        while node > 0:
            other = self.losers[node]
            if other < 0:
                # Nobody has come here yet: wait for the run from the other side.
                self.losers[node] = winner
                return
            if self._beats(other, winner):
                self.losers[node], winner = winner, other
            node //= 2
        self.losers[0] = winner

    def __iter__(self) -> Iterator[tuple]:
        """(run, item) in order."""
        while self.runs:
            run = self.losers[0]
            item = self.heads[run]
            if item is None:
                return
            yield run, item
            self.heads[run] = next(self.runs[run], None)
            self._play(run)


_KEY = ["url_key", "captured_at", "page_id", "file", "offset"]


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces of runs, one after the other and each sorted, into one sorted range; memory holds one range."""
    table = [b for b in batches if b.num_rows]
    if not table:
        return
    whole = pa.Table.from_batches(table)
    keys = [whole.column(c).to_pylist() for c in _KEY]
    runs = whole.column("run").to_pylist()
    borders = [0, *[i for i in range(1, len(runs)) if runs[i] != runs[i - 1]], len(runs)]

    def piece(start: int, stop: int) -> Iterator[tuple]:
        for i in range(start, stop):
            # Pages without an id come last among those of one URL and time.
            yield (keys[0][i], keys[1][i], keys[2][i] is None, keys[2][i] or 0, keys[3][i], keys[4][i], i)

    tree = LoserTree([piece(a, b) for a, b in zip(borders, borders[1:])])
    order = pa.array([item[-1] for _, item in tree], pa.int64())
    merged = whole.drop_columns(["run"]).take(order)
    part = TaskContext.get().partitionId()
    merged = merged.append_column("range", pa.array([part] * len(order), pa.int32()))
    merged = merged.append_column("place", pa.array(range(len(order)), pa.int64()))
    yield from merged.to_batches(10_000)


def merged_index(captures: DataFrame, per_range: int = CAPTURES_PER_RANGE) -> DataFrame:
    """`captures` with url_key and capture_no, their number from 0 in the order of URL key, time and id."""
    keyed = captures.withColumn("url_key", url_key(F.col("uri"))).withColumn("run", F.spark_partition_id())
    runs = store(keyed.sortWithinPartitions(*_KEY), "runs")
    ranges = max(1, -(-runs.rows // per_range))
    pieces = runs.df.repartitionByRange(ranges, *[F.asc_nulls_last(c) for c in _KEY]).sortWithinPartitions(
        "run", *[F.asc_nulls_last(c) for c in _KEY]
    )
    kinds = {f.name: f.dataType.simpleString() for f in runs.df.schema if f.name != "run"}
    schema = ", ".join(f"{k} {v}" for k, v in kinds.items()) + ", range int, place long"
    merged = store(pieces.select(*kinds, "run").mapInArrow(_merge, schema), "index").df
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    # One row per range.
    starts = merged.groupBy("range").agg(F.count(F.lit(1)).alias("n")).select(
        "range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")
    )
    return merged.join(F.broadcast(starts), "range").select(
        *kinds, (F.col("base") + F.col("place")).alias("capture_no")
    )


def archive(pages: DataFrame) -> DataFrame:
    """Write, read back and index: one row per page, in the columns of the query."""
    folder = fresh_path(pages.sparkSession, "archives")
    write_archives(pages, folder)
    index = merged_index(read_archives(pages.sparkSession, folder))
    return index.select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "captured_at", "capture_no"
    )
