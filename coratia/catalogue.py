"""The operators applied to the benchmark tables, each with its SQL equivalent where one exists.

Every query reads whole tables. The SQL texts are independent statements of the same
result in DuckDB's dialect.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from coratia.functions import words
from coratia.operators import baskets, graph, ids, recommend, similarity, stats
from coratia.plans.lineage import cut_lineage, fresh_path
from coratia.plans.scan import dealt_out
from coratia.sources import readers, writers

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def _register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(query: Query) -> Query:
        QUERIES[name] = query
        if sql is not None:
            SQL[name] = sql
        return query

    return add


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _scratch(spark: SparkSession) -> str:
    """A new folder for a query that writes and reads back."""
    return fresh_path(spark, "written")


# --- parameters of the queries ------------------------------------------------------

# A set is frequent if this share of the baskets holds it.
SUPPORT_SHARE = 0.00475
MIN_ITEMS = 4
CHUNKS = 3
# Orders from this day on are the requests of the rating predictions, all others train them.
REQUESTS_FROM = "2001-01-01"
GRAPH_THRESHOLD = 36
COMMUNITY_THRESHOLD = 39
# The prime 2 ** 31 - 1, above the number of words at any scale.
HASHES, HASH_MODULUS = similarity.hash_family(similarity.BANDS * similarity.ROWS, 2**31 - 2)


# --- inputs -----------------------------------------------------------------------


def _brand_lines(spark: SparkSession, folder: str) -> DataFrame:
    lines = _table(spark, folder, "lineitem").select("l_orderkey", "l_partkey")
    brands = _table(spark, folder, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand")
    return lines.join(brands, "l_partkey").withColumn("chunk", F.col("l_orderkey") % CHUNKS)


_BRANDS = f"""
brands AS (
  SELECT DISTINCT l_orderkey AS basket, p_brand AS item, l_orderkey % {CHUNKS} AS chunk
  FROM lineitem JOIN part ON l_partkey = p_partkey
)"""


def _support(items: DataFrame) -> int:
    n_baskets = items.select("basket").distinct().count()
    return max(1, int(-(-n_baskets * SUPPORT_SHARE // 1)))


def _support_sql(table: str) -> str:
    return f"(SELECT greatest(1, CAST(ceil(count(DISTINCT basket) * {SUPPORT_SHARE}) AS BIGINT)) FROM {table})"


def _stars() -> Column:
    return F.floor((F.col("l_quantity") - 1) / 10).cast("double") + 1


def _rating_lines(spark: SparkSession, folder: str) -> DataFrame:
    lines = _table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", F.col("l_suppkey").alias("business_id"), _stars().alias("stars")
    )
    orders = _table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("user_id"), "o_orderdate"
    )
    return lines.join(orders, "l_orderkey")


def _train_and_requests(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    lines = _rating_lines(spark, folder)
    requested = F.col("o_orderdate") >= F.lit(REQUESTS_FROM).cast("timestamp_ntz")
    return lines.filter(~requested), lines.filter(requested).select("user_id", "business_id")


_RATED_ORDER = ["l_orderkey", "l_linenumber", "stars"]


def _ratings(spark: SparkSession, folder: str) -> tuple[recommend.Ratings, DataFrame]:
    train, requests = _train_and_requests(spark, folder)
    return recommend.prepare_ratings(train, order_by=_RATED_ORDER), requests


_RATED = f"""
rated AS (
  SELECT o_custkey AS u, l_suppkey AS b, floor((l_quantity - 1) / 10) + 1 AS stars,
         l_orderkey, l_linenumber, o_orderdate
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey
),
train AS (SELECT * FROM rated WHERE o_orderdate < TIMESTAMP '{REQUESTS_FROM}'),
requests AS (SELECT u, b FROM rated WHERE o_orderdate >= TIMESTAMP '{REQUESTS_FROM}'),
cells AS (
  SELECT u, b, stars AS r FROM (
    SELECT *, row_number() OVER (PARTITION BY u, b
                                 ORDER BY l_orderkey DESC, l_linenumber DESC, stars DESC) AS latest
    FROM train)
  WHERE latest = 1
),
users AS (SELECT u, sum(stars) AS s, count(*) AS n FROM train GROUP BY u),
items AS (SELECT b, sum(stars) AS s, count(*) AS n FROM train GROUP BY b)"""


def _document_words(spark: SparkSession, folder: str) -> DataFrame:
    documents = dealt_out(_table(spark, folder, "documents").select("doc_id", "text"), "doc_id")
    return documents.select("doc_id", F.explode(F.array_distinct(words(F.col("text")))).alias("word"))


_WORDS = """
words AS (
  SELECT DISTINCT doc_id AS item, unnest(regexp_extract_all(lower(text), '\\p{L}+')) AS member
  FROM documents
),
sizes AS (SELECT item, count(*) AS n FROM words GROUP BY item),
shared AS (
  SELECT a.item AS id_1, b.item AS id_2, count(*) AS overlap
  FROM words a JOIN words b ON a.member = b.member AND a.item < b.item
  GROUP BY a.item, b.item
),
similar_pairs AS (
  SELECT id_1, id_2, overlap / (x.n + y.n - overlap) AS similarity
  FROM shared JOIN sizes x ON x.item = id_1 JOIN sizes y ON y.item = id_2
  WHERE overlap / (x.n + y.n - overlap) >= 0.5
)"""

_HASHED = f"""
codes AS (SELECT member, row_number() OVER (ORDER BY member) - 1 AS code FROM (SELECT DISTINCT member FROM words)),
functions(position, a, b) AS (VALUES {", ".join(f"({i}, {a}, {b})" for i, (a, b) in enumerate(HASHES))}),
minima AS (
  SELECT item, position, min((a * code + b) % {HASH_MODULUS}) AS value
  FROM words JOIN codes USING (member) CROSS JOIN functions
  GROUP BY item, position
),
bands AS (
  SELECT item, position // {similarity.ROWS} AS band,
         string_agg(CAST(value AS VARCHAR), ',' ORDER BY position) AS key
  FROM minima GROUP BY item, position // {similarity.ROWS}
)"""


def _visits(spark: SparkSession, folder: str) -> DataFrame:
    return _table(spark, folder, "events").select(
        "user_id", F.get_json_object("props", "$.k").cast("int").alias("k")
    )


def _event_graph(spark: SparkSession, folder: str, threshold: int = GRAPH_THRESHOLD) -> DataFrame:
    return graph.co_graph(_visits(spark, folder), "user_id", "k", threshold)


_GRAPH = f"""
visits AS (SELECT DISTINCT user_id AS u, CAST(regexp_extract(props, '[0-9]+') AS INTEGER) AS k FROM events),
edges AS (
  SELECT a.u AS src, b.u AS dst FROM visits a JOIN visits b ON a.k = b.k AND a.u <> b.u
  GROUP BY a.u, b.u HAVING count(*) >= {GRAPH_THRESHOLD}
)"""

_PATHS = (
    _GRAPH
    + """,
reached(root, node, level) AS (
  SELECT DISTINCT src, src, 0 FROM edges
  UNION
  SELECT root, dst, level + 1 FROM reached JOIN edges ON src = node
  WHERE level < (SELECT count(DISTINCT src) FROM edges)
),
distances AS (SELECT root, node, min(level) AS level FROM reached GROUP BY root, node),
walks(root, node, level) AS (
  SELECT DISTINCT src, src, 0 FROM edges
  UNION ALL
  SELECT w.root, e.dst, w.level + 1
  FROM walks w JOIN edges e ON e.src = w.node
  JOIN distances d ON d.root = w.root AND d.node = e.dst AND d.level = w.level + 1
),
paths AS (SELECT root, node, level, count(*) AS sigma FROM walks GROUP BY root, node, level)"""
)

_BETWEENNESS = (
    _PATHS
    + """,
betweenness AS (
  SELECT least(e.src, e.dst) AS src, greatest(e.src, e.dst) AS dst,
         sum(p.sigma * q.sigma / st.sigma) AS value
  FROM edges e
  JOIN paths p ON p.node = e.src
  JOIN paths q ON q.root = e.dst
  JOIN paths st ON st.root = p.root AND st.node = q.node AND st.level = p.level + 1 + q.level
  WHERE p.root < q.node
  GROUP BY 1, 2
)"""
)


# Rounds of splitting that the SQL spells out; the graph at sf0.01 needs seven.
_SPLIT_ROUNDS = 9


def _split_sql(rounds: int) -> str:
    """g0, g1, ...: the graph after so many rounds of dropping its top edges; m0, m1, ...: its components; q0, q1, ...: their modularity."""
    parts = [_GRAPH.replace(f">= {GRAPH_THRESHOLD}", f">= {COMMUNITY_THRESHOLD}"), "g0 AS MATERIALIZED (SELECT src, dst FROM edges)"]
    for k in range(rounds + 1):
        parts.append(f"""
reached{k}(root, node, level) AS (
  SELECT DISTINCT src, src, 0 FROM edges
  UNION
  SELECT root, dst, level + 1 FROM reached{k} JOIN g{k} ON src = node
  WHERE level < (SELECT count(DISTINCT src) FROM edges)
),
distances{k} AS MATERIALIZED (SELECT root, node, min(level) AS level FROM reached{k} GROUP BY root, node),
m{k} AS MATERIALIZED (SELECT node, min(root) AS community FROM distances{k} GROUP BY node),
q{k} AS (
  SELECT {k} AS round, sum(e / m2 - (d / m2) * (d / m2)) AS q FROM (
    SELECT a.community, count(*) AS d, count(*) FILTER (WHERE a.community = b.community) AS e
    FROM edges JOIN m{k} a ON a.node = src JOIN m{k} b ON b.node = dst GROUP BY 1), (SELECT count(*) AS m2 FROM edges)
)""")
        if k == rounds:
            break
        parts.append(f"""
walks{k}(root, node, level) AS (
  SELECT DISTINCT src, src, 0 FROM edges
  UNION ALL
  SELECT w.root, e.dst, w.level + 1 FROM walks{k} w JOIN g{k} e ON e.src = w.node
  JOIN distances{k} d ON d.root = w.root AND d.node = e.dst AND d.level = w.level + 1
),
paths{k} AS MATERIALIZED (SELECT root, node, level, count(*) AS sigma FROM walks{k} GROUP BY root, node, level),
between{k} AS MATERIALIZED (
  SELECT least(e.src, e.dst) AS src, greatest(e.src, e.dst) AS dst, round(sum(p.sigma * q.sigma / st.sigma), 9) AS value
  FROM g{k} e JOIN paths{k} p ON p.node = e.src JOIN paths{k} q ON q.root = e.dst
  JOIN paths{k} st ON st.root = p.root AND st.node = q.node AND st.level = p.level + 1 + q.level
  WHERE p.root < q.node GROUP BY 1, 2
),
g{k + 1} AS MATERIALIZED (
  SELECT g.src, g.dst FROM g{k} g JOIN between{k} b ON b.src = least(g.src, g.dst) AND b.dst = greatest(g.src, g.dst)
  WHERE (SELECT max(value) FROM between{k}) > 1 AND value < (SELECT max(value) FROM between{k})
)""")
    return "WITH RECURSIVE " + ",".join(parts)


def _best_split_sql(rounds: int) -> str:
    scores = " UNION ALL ".join(f"SELECT * FROM q{k}" for k in range(rounds + 1))
    members = " UNION ALL ".join(f"SELECT {k} AS round, node, community FROM m{k}" for k in range(rounds + 1))
    return f"""{_split_sql(rounds)},
best AS (SELECT round FROM ({scores}) ORDER BY round(q, 9) DESC, round LIMIT 1)
SELECT node, community FROM ({members}) JOIN best USING (round)"""


# --- statistics -------------------------------------------------------------------


@_register("count_positive", "SELECT count(*) AS n FROM events WHERE value > 0")
def count_positive(spark: SparkSession, folder: str) -> DataFrame:
    return stats.count_where(_table(spark, folder, "events"), F.col("value") > 0)


@_register("count_equal", "SELECT count(*) AS n FROM lineitem WHERE l_quantity = 5.0")
def count_equal(spark: SparkSession, folder: str) -> DataFrame:
    return stats.count_where(_table(spark, folder, "lineitem"), F.col("l_quantity") == 5.0)


@_register("max_text_len", "SELECT max(length(text)) AS n_characters FROM documents")
def max_text_len(spark: SparkSession, folder: str) -> DataFrame:
    return stats.longest(_table(spark, folder, "documents"), "text")


@_register("distinct_users", "SELECT count(DISTINCT user_id) AS n FROM events")
def distinct_users(spark: SparkSession, folder: str) -> DataFrame:
    return stats.distinct_count(_table(spark, folder, "events"), "user_id")


@_register("distinct_items", "SELECT count(DISTINCT l_partkey) AS n FROM lineitem")
def distinct_items(spark: SparkSession, folder: str) -> DataFrame:
    return stats.distinct_count(_table(spark, folder, "lineitem"), "l_partkey")


@_register(
    "distinct_users_sketched",
    """
WITH days AS (SELECT strftime(ts, '%Y-%m-%d') AS day, user_id FROM events)
SELECT coalesce(day, 'all') AS period, count(DISTINCT user_id) AS n, true AS near
FROM days GROUP BY GROUPING SETS ((day), ())""",
)
def distinct_users_sketched(spark: SparkSession, folder: str) -> DataFrame:
    """Distinct users per day and of all days, and whether the sketches of the days, stored and united, come near (5 errors)."""
    events = _table(spark, folder, "events").select(F.date_format("ts", "yyyy-MM-dd").alias("period"), "user_id")
    daily = cut_lineage(stats.distinct_sketches(events, ["period"], "user_id"))
    united = stats.united_sketches(daily).select(F.lit("all").alias("period"), "sketch")
    estimated = stats.sketched_counts(daily.unionByName(united), "estimate")
    exact = events.groupBy("period").agg(F.count_distinct("user_id").alias("n"))
    total = stats.distinct_count(events, "user_id").select(F.lit("all").alias("period"), "n")
    allowed = F.col("n") * (5 * stats.sketch_error()) + 1
    return exact.unionByName(total).join(estimated, "period").select(
        "period", "n", (F.abs(F.col("estimate") - F.col("n")) <= allowed).alias("near")
    )


@_register(
    "top20_users",
    "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey ORDER BY n DESC, o_custkey LIMIT 20",
)
def top20_users(spark: SparkSession, folder: str) -> DataFrame:
    return stats.top_keys(_table(spark, folder, "orders"), "o_custkey")


@_register(
    "top20_items",
    "SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY l_partkey ORDER BY n DESC, l_partkey LIMIT 20",
)
def top20_items(spark: SparkSession, folder: str) -> DataFrame:
    return stats.top_keys(_table(spark, folder, "lineitem"), "l_partkey")


def _reviews(spark: SparkSession, folder: str) -> DataFrame:
    lines = _table(spark, folder, "lineitem").select(
        F.col("l_suppkey").alias("user_id"),
        F.col("l_partkey").alias("business_id"),
        _stars().alias("stars"),
        (F.col("l_linenumber") - 3).cast("long").alias("useful"),
    )
    names = _table(spark, folder, "part").select(
        F.col("p_partkey").alias("business_id"), F.col("p_name").alias("text")
    )
    return lines.join(names, "business_id")


_REVIEWS = """
reviews AS (
  SELECT l_suppkey AS user_id, l_partkey AS business_id, floor((l_quantity - 1) / 10) + 1 AS stars,
         CAST(l_linenumber - 3 AS BIGINT) AS useful, p_name AS text
  FROM lineitem JOIN part ON l_partkey = p_partkey
)"""


@_register(
    "review_summary",
    f"""
WITH {_REVIEWS},
top_users AS (SELECT user_id AS id, count(*) AS n FROM reviews GROUP BY 1 ORDER BY n DESC, id LIMIT 20),
top_items AS (SELECT business_id AS id, count(*) AS n FROM reviews GROUP BY 1 ORDER BY n DESC, id LIMIT 20)
SELECT count(*) FILTER (WHERE useful > 0) AS n_review_useful,
       count(*) FILTER (WHERE stars = 5.0) AS n_review_5_star,
       max(length(text)) AS n_characters,
       count(DISTINCT user_id) AS n_user,
       (SELECT string_agg(id || ':' || n, ' ' ORDER BY n DESC, id) FROM top_users) AS top20_user,
       count(DISTINCT business_id) AS n_business,
       (SELECT string_agg(id || ':' || n, ' ' ORDER BY n DESC, id) FROM top_items) AS top20_business
FROM reviews""",
)
def review_summary(spark: SparkSession, folder: str) -> DataFrame:
    summary = stats.review_summary(_reviews(spark, folder))

    def spelled(column: str) -> Column:
        entries = F.transform(column, lambda e: F.concat_ws(":", e["id"].cast("string"), e["n"].cast("string")))
        return F.array_join(entries, " ").alias(column)

    return summary.select(
        "n_review_useful",
        "n_review_5_star",
        "n_characters",
        "n_user",
        spelled("top20_user"),
        "n_business",
        spelled("top20_business"),
    )


def _state_averages(spark: SparkSession, folder: str) -> DataFrame:
    nations = _table(spark, folder, "nation").select(
        F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("state")
    )
    customers = _table(spark, folder, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
    orders = _table(spark, folder, "orders").select("o_custkey", "o_totalprice")
    return stats.average_by_attribute(
        orders, customers.join(nations, "c_nationkey"), "o_custkey", "state", "o_totalprice"
    )


_STATE_SQL = """
SELECT n_name AS state, round(avg(o_totalprice), 4) AS stars
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
GROUP BY n_name"""


@_register("avg_by_state", _STATE_SQL)
def avg_by_state(spark: SparkSession, folder: str) -> DataFrame:
    return _state_averages(spark, folder).withColumn("stars", F.round("stars", 4))


@_register("top5_state", _STATE_SQL + " ORDER BY avg(o_totalprice) DESC, n_name LIMIT 5")
def top5_state(spark: SparkSession, folder: str) -> DataFrame:
    averages = stats.top_averages(_state_averages(spark, folder), "state")
    return averages.withColumn("stars", F.round("stars", 4))


# --- baskets ------------------------------------------------------------------------


def _spelled_items(df: DataFrame) -> DataFrame:
    return df.withColumn("items", F.array_join("items", ","))


@_register(
    "basket_sizes",
    f"WITH {_BRANDS} SELECT basket, count(*) AS n_items FROM brands GROUP BY basket",
)
def basket_sizes(spark: SparkSession, folder: str) -> DataFrame:
    return baskets.basket_sizes(
        baskets.orient(_brand_lines(spark, folder), 1, "l_orderkey", "p_brand")
    )


@_register(
    "basket_sizes_swapped",
    f"WITH {_BRANDS} SELECT item AS basket, count(*) AS n_items FROM brands GROUP BY item",
)
def basket_sizes_swapped(spark: SparkSession, folder: str) -> DataFrame:
    return baskets.basket_sizes(
        baskets.orient(_brand_lines(spark, folder), 2, "l_orderkey", "p_brand")
    )


@_register(
    "baskets_filtered",
    f"""
WITH {_BRANDS}
SELECT basket, count(*) AS n_items FROM brands GROUP BY basket HAVING count(*) > {MIN_ITEMS}""",
)
def baskets_filtered(spark: SparkSession, folder: str) -> DataFrame:
    items = baskets.basket_items(_brand_lines(spark, folder), "l_orderkey", "p_brand", MIN_ITEMS)
    return baskets.basket_sizes(items)


def _itemset_sql(source: str) -> str:
    support = _support_sql("source")
    return f"""
WITH {_BRANDS},
source AS ({source}),
l1 AS (SELECT item, count(*) AS freq FROM source GROUP BY item HAVING count(*) >= {support}),
kept AS (SELECT basket, item FROM source JOIN l1 USING (item)),
l2 AS (
  SELECT a.item AS i1, b.item AS i2, count(*) AS freq
  FROM kept a JOIN kept b ON a.basket = b.basket AND a.item < b.item
  GROUP BY 1, 2 HAVING count(*) >= {support}
),
l3 AS (
  SELECT i1, i2, c.item AS i3, count(*) AS freq
  FROM l2 JOIN kept a ON a.item = i1
  JOIN kept b ON b.basket = a.basket AND b.item = i2
  JOIN kept c ON c.basket = a.basket AND c.item > i2
  GROUP BY 1, 2, 3 HAVING count(*) >= {support}
),
l4 AS (
  SELECT i1, i2, i3, d.item AS i4, count(*) AS freq
  FROM l3 JOIN kept a ON a.item = i1
  JOIN kept b ON b.basket = a.basket AND b.item = i2
  JOIN kept c ON c.basket = a.basket AND c.item = i3
  JOIN kept d ON d.basket = a.basket AND d.item > i3
  GROUP BY 1, 2, 3, 4 HAVING count(*) >= {support}
),
l5 AS (
  SELECT i1, i2, i3, i4, e.item AS i5, count(*) AS freq
  FROM l4 JOIN kept a ON a.item = i1
  JOIN kept b ON b.basket = a.basket AND b.item = i2
  JOIN kept c ON c.basket = a.basket AND c.item = i3
  JOIN kept d ON d.basket = a.basket AND d.item = i4
  JOIN kept e ON e.basket = a.basket AND e.item > i4
  GROUP BY 1, 2, 3, 4, 5 HAVING count(*) >= {support}
)
SELECT 1 AS size, item AS items, freq FROM l1
UNION ALL SELECT 2, concat_ws(',', i1, i2), freq FROM l2
UNION ALL SELECT 3, concat_ws(',', i1, i2, i3), freq FROM l3
UNION ALL SELECT 4, concat_ws(',', i1, i2, i3, i4), freq FROM l4
UNION ALL SELECT 5, concat_ws(',', i1, i2, i3, i4, i5), freq FROM l5"""


@_register("frequent_itemsets", _itemset_sql("SELECT basket, item FROM brands"))
def frequent_itemsets(spark: SparkSession, folder: str) -> DataFrame:
    items = cut_lineage(baskets.basket_items(_brand_lines(spark, folder), "l_orderkey", "p_brand"))
    return _spelled_items(baskets.frequent_itemsets(items, _support(items)))


@_register("frequent_itemsets_fp", SQL["frequent_itemsets"])
def frequent_itemsets_fp(spark: SparkSession, folder: str) -> DataFrame:
    items = cut_lineage(baskets.basket_items(_brand_lines(spark, folder), "l_orderkey", "p_brand"))
    return _spelled_items(baskets.frequent_itemsets_fp(items, _support(items)))


@_register(
    "frequent_itemsets_filtered",
    _itemset_sql(
        f"""SELECT basket, item FROM brands WHERE basket IN (
    SELECT basket FROM brands GROUP BY basket HAVING count(*) > {MIN_ITEMS})"""
    ),
)
def frequent_itemsets_filtered(spark: SparkSession, folder: str) -> DataFrame:
    lines = _brand_lines(spark, folder)
    items = cut_lineage(baskets.basket_items(lines, "l_orderkey", "p_brand", MIN_ITEMS))
    return _spelled_items(baskets.frequent_itemsets_fp(items, _support(items)))


_SON = f"""
WITH {_BRANDS},
chunks AS (SELECT chunk, count(DISTINCT basket) AS n_chunk FROM brands GROUP BY chunk),
n AS (SELECT sum(n_chunk) AS n_baskets, {_support_sql("brands")} AS support FROM chunks),
c1 AS (
  SELECT DISTINCT item FROM (
    SELECT item, chunk, count(*) AS freq FROM brands GROUP BY item, chunk) JOIN chunks USING (chunk), n
  WHERE freq * n_baskets >= support * n_chunk
),
l1 AS (SELECT item, count(*) AS freq FROM brands, n GROUP BY item HAVING count(*) >= any_value(support)),
kept AS (SELECT basket, chunk, item FROM brands JOIN l1 USING (item)),
n2 AS (
  SELECT a.item AS i1, b.item AS i2, a.chunk AS chunk, count(*) AS freq
  FROM kept a JOIN kept b ON a.basket = b.basket AND a.item < b.item GROUP BY 1, 2, 3
),
c2 AS (
  SELECT DISTINCT i1, i2 FROM n2 JOIN chunks USING (chunk), n
  WHERE freq * n_baskets >= support * n_chunk
),
l2 AS (SELECT i1, i2, sum(freq) AS freq FROM n2, n GROUP BY 1, 2 HAVING sum(freq) >= any_value(support)),
n3 AS (
  SELECT x.i1 AS i1, x.i2 AS i2, y.i2 AS i3, a.chunk AS chunk, count(*) AS freq
  FROM l2 x JOIN l2 y ON x.i1 = y.i1 AND x.i2 < y.i2
  JOIN kept a ON a.item = x.i1
  JOIN kept b ON b.basket = a.basket AND b.item = x.i2
  JOIN kept c ON c.basket = a.basket AND c.item = y.i2
  GROUP BY 1, 2, 3, 4
),
c3 AS (
  SELECT DISTINCT i1, i2, i3 FROM n3 JOIN chunks USING (chunk), n
  WHERE freq * n_baskets >= support * n_chunk
),
l3 AS (SELECT i1, i2, i3, sum(freq) AS freq FROM n3, n GROUP BY 1, 2, 3 HAVING sum(freq) >= any_value(support)),
n4 AS (
  SELECT x.i1 AS i1, x.i2 AS i2, x.i3 AS i3, y.i3 AS i4, a.chunk AS chunk, count(*) AS freq
  FROM l3 x JOIN l3 y ON x.i1 = y.i1 AND x.i2 = y.i2 AND x.i3 < y.i3
  JOIN kept a ON a.item = x.i1
  JOIN kept b ON b.basket = a.basket AND b.item = x.i2
  JOIN kept c ON c.basket = a.basket AND c.item = x.i3
  JOIN kept d ON d.basket = a.basket AND d.item = y.i3
  GROUP BY 1, 2, 3, 4, 5
),
c4 AS (
  SELECT DISTINCT i1, i2, i3, i4 FROM n4 JOIN chunks USING (chunk), n
  WHERE freq * n_baskets >= support * n_chunk
),
l4 AS (SELECT i1, i2, i3, i4, sum(freq) AS freq FROM n4, n GROUP BY 1, 2, 3, 4 HAVING sum(freq) >= any_value(support)),
report AS (
  SELECT 'candidate' AS kind, 1 AS size, item AS items, CAST(NULL AS BIGINT) AS freq FROM c1
  WHERE EXISTS (SELECT 1 FROM l1)
  UNION ALL SELECT 'candidate', 2, concat_ws(',', i1, i2), NULL FROM c2 WHERE EXISTS (SELECT 1 FROM l2)
  UNION ALL SELECT 'candidate', 3, concat_ws(',', i1, i2, i3), NULL FROM c3 WHERE EXISTS (SELECT 1 FROM l3)
  UNION ALL SELECT 'candidate', 4, concat_ws(',', i1, i2, i3, i4), NULL FROM c4 WHERE EXISTS (SELECT 1 FROM l4)
  UNION ALL SELECT 'frequent', 1, item, freq FROM l1
  UNION ALL SELECT 'frequent', 2, concat_ws(',', i1, i2), CAST(freq AS BIGINT) FROM l2
  UNION ALL SELECT 'frequent', 3, concat_ws(',', i1, i2, i3), CAST(freq AS BIGINT) FROM l3
  UNION ALL SELECT 'frequent', 4, concat_ws(',', i1, i2, i3, i4), CAST(freq AS BIGINT) FROM l4
)"""


def _chunked_items(spark: SparkSession, folder: str) -> DataFrame:
    lines = _brand_lines(spark, folder)
    return cut_lineage(baskets.basket_items(lines, "l_orderkey", "p_brand", chunk="chunk"))


@_register("itemset_report", _SON + " SELECT kind, size, items, freq FROM report")
def itemset_report(spark: SparkSession, folder: str) -> DataFrame:
    items = _chunked_items(spark, folder)
    return _spelled_items(baskets.itemset_report(items, _support(items)))


@_register("son_candidates", _SON + " SELECT concat_ws(',', i1, i2) AS items FROM c2")
def son_candidates(spark: SparkSession, folder: str) -> DataFrame:
    items = _chunked_items(spark, folder)
    support = _support(items)
    singles = baskets.count_candidates(items, baskets.son_candidates(items, support), support)
    return _spelled_items(baskets.son_candidates(items, support, singles))


@_register("counted_candidates", _SON + " SELECT concat_ws(',', i1, i2) AS items, CAST(freq AS BIGINT) AS freq FROM l2")
def counted_candidates(spark: SparkSession, folder: str) -> DataFrame:
    items = _chunked_items(spark, folder)
    support = _support(items)
    singles = baskets.count_candidates(items, baskets.son_candidates(items, support), support)
    pairs = baskets.son_candidates(items, support, singles)
    return _spelled_items(baskets.count_candidates(items, pairs, support))


@_register("son_candidates_3", _SON + " SELECT concat_ws(',', i1, i2, i3) AS items FROM c3")
def son_candidates_3(spark: SparkSession, folder: str) -> DataFrame:
    items = _chunked_items(spark, folder)
    support = _support(items)
    singles = baskets.count_candidates(items, baskets.son_candidates(items, support), support)
    pairs = baskets.count_candidates(items, baskets.son_candidates(items, support, singles), support)
    return _spelled_items(baskets.son_candidates(items, support, pairs))


# --- similar pairs --------------------------------------------------------------------


@_register(
    "encode_ids",
    """
SELECT id, row_number() OVER (ORDER BY id) - 1 AS code
FROM (SELECT c_name AS id FROM customer UNION SELECT s_name FROM supplier)""",
)
def encode_ids(spark: SparkSession, folder: str) -> DataFrame:
    customers = _table(spark, folder, "customer").select(F.col("c_name").alias("id"))
    suppliers = _table(spark, folder, "supplier").select(F.col("s_name").alias("id"))
    return ids.id_dictionary(customers.unionByName(suppliers), ["id"])


def _signed_documents(spark: SparkSession, folder: str) -> DataFrame:
    sets = cut_lineage(similarity.member_sets(_document_words(spark, folder), "doc_id", "word"))
    codes = ids.id_dictionary(sets, ["member"], "member")
    coded = sets.join(codes, "member").select("item", "code")
    return similarity.signatures(coded, HASHES, HASH_MODULUS, sizes=similarity.set_sizes(sets))


@_register("minhash_signatures", f"WITH {_WORDS}, {_HASHED} SELECT item, position, value FROM minima")
def minhash_signatures(spark: SparkSession, folder: str) -> DataFrame:
    signed = _signed_documents(spark, folder)
    return signed.select("item", F.posexplode("signature").alias("position", "value"))


@_register(
    "lsh_buckets",
    f"""
WITH {_WORDS}, {_HASHED}
SELECT CAST(band AS INTEGER) AS band, key, count(*) AS n_items FROM bands GROUP BY band, key HAVING count(*) > 1""",
)
def lsh_buckets(spark: SparkSession, folder: str) -> DataFrame:
    banded = similarity.band_rows(_signed_documents(spark, folder))
    return (
        banded.groupBy("band", "key")
        .agg(F.count(F.lit(1)).alias("n_items"))
        .filter(F.col("n_items") > 1)
        .select("band", F.array_join(F.col("key").cast("array<string>"), ",").alias("key"), "n_items")
    )


def _rounded(pairs: DataFrame) -> DataFrame:
    return pairs.withColumn("similarity", F.round("similarity", 6))


@_register(
    "jaccard_exact",
    f"WITH {_WORDS} SELECT id_1, id_2, round(similarity, 6) AS similarity FROM similar_pairs",
)
def jaccard_exact(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(similarity.exact_similar_pairs(_document_words(spark, folder), "doc_id", "word"))


@_register(
    "jaccard_lsh",
    f"""
WITH {_WORDS}, {_HASHED}
SELECT id_1, id_2, round(similarity, 6) AS similarity FROM similar_pairs
WHERE EXISTS (SELECT 1 FROM bands x JOIN bands y ON x.band = y.band AND x.key = y.key
              WHERE x.item = id_1 AND y.item = id_2)""",
)
def jaccard_lsh(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(
        similarity.similar_pairs(_document_words(spark, folder), "doc_id", "word", HASHES, HASH_MODULUS)
    )


@_register(
    "similar_sets",
    f"""
WITH {_WORDS},
spelled AS (SELECT item, string_agg(member, ' ' ORDER BY member) AS content FROM words GROUP BY item),
reps AS (SELECT min(item) AS item, count(*) AS copies FROM spelled GROUP BY content)
SELECT id_1 AS item_1, id_2 AS item_2, x.copies AS copies_1, y.copies AS copies_2, round(similarity, 6) AS similarity
FROM similar_pairs JOIN reps x ON x.item = id_1 JOIN reps y ON y.item = id_2""",
)
def similar_sets(spark: SparkSession, folder: str) -> DataFrame:
    pairs, identical = similarity.similar_representatives(
        _document_words(spark, folder), "doc_id", "word"
    )
    copies = identical.df.groupBy("rep").agg(F.count(F.lit(1)).alias("copies"))
    for side in ("1", "2"):
        named = copies.select(F.col("rep").alias(f"item_{side}"), F.col("copies").alias(f"copies_{side}"))
        pairs = pairs.join(named, f"item_{side}")
    return _rounded(pairs.select("item_1", "item_2", "copies_1", "copies_2", "similarity"))


# --- rating prediction -------------------------------------------------------------------


@_register("last_ratings", f"WITH {_RATED} SELECT u AS user, b AS item, r FROM cells")
def last_ratings(spark: SparkSession, folder: str) -> DataFrame:
    return _ratings(spark, folder)[0].cells


@_register("user_totals", f"WITH {_RATED} SELECT u AS user, s, n FROM users")
def user_totals(spark: SparkSession, folder: str) -> DataFrame:
    return _ratings(spark, folder)[0].users.df.select("user", "s", "n")


@_register(
    "unrated_requests",
    f"""
WITH {_RATED}
SELECT u AS user_id, b AS business_id, count(*) AS n FROM requests
WHERE NOT EXISTS (SELECT 1 FROM cells WHERE cells.u = requests.u AND cells.b = requests.b)
GROUP BY u, b""",
)
def unrated_requests(spark: SparkSession, folder: str) -> DataFrame:
    train, requests = _train_and_requests(spark, folder)
    asked = requests.groupBy("user_id", "business_id").agg(F.count(F.lit(1)).alias("n"))
    return asked.join(train.select("user_id", "business_id"), ["user_id", "business_id"], "left_anti")


_CORRELATION = "(n * sxy - sx * sy) / (sqrt(n * sxx - sx * sx) * sqrt(n * syy - sy * sy))"


def _pairs_sql(name: str, key: str, by: str, where: str) -> str:
    return f"""
{name} AS (
  SELECT one, two, n, {_CORRELATION} AS w FROM (
    SELECT x.{key} AS one, y.{key} AS two, count(*) AS n, sum(x.r) AS sx, sum(y.r) AS sy,
           sum(x.r * x.r) AS sxx, sum(y.r * y.r) AS syy, sum(x.r * y.r) AS sxy
    FROM cells x JOIN cells y ON x.{by} = y.{by}
    WHERE {where} GROUP BY 1, 2 HAVING count(*) > 2)
  WHERE n * sxy - sx * sy > 0
)"""


@_register(
    "pearson_items",
    f"""
WITH {_RATED}, {_pairs_sql("pairs", "b", "u", "x.b < y.b")}
SELECT one AS member_1, two AS member_2, round(w, 6) AS w FROM pairs""",
)
def pearson_items(spark: SparkSession, folder: str) -> DataFrame:
    ratings, _ = _ratings(spark, folder)
    pairs = recommend.positive_correlations(recommend.pearson_pairs(ratings.cells, "item", "user"))
    return pairs.withColumn("w", F.round("w", 6))


@_register("pearson_blocked", SQL["pearson_items"])
def pearson_blocked(spark: SparkSession, folder: str) -> DataFrame:
    """The same pairs from products of blocked matrices, however few they are."""
    ratings, _ = _ratings(spark, folder)
    pairs = recommend.blocked_correlations(ratings.cells, "item", "user", cells_per_match=float("inf"), fewest_matches=0)
    return pairs.withColumn("w", F.round("w", 6))


def _rated_answers(predictions: DataFrame) -> DataFrame:
    return predictions.withColumn("rating", F.round("rating", 6))


@_register(
    "cf_user",
    f"""
WITH {_RATED}, {_pairs_sql("pairs", "u", "b", "x.u IN (SELECT u FROM requests)")},
asked AS (SELECT DISTINCT u, b FROM requests),
raters AS (SELECT b, count(*) AS k FROM cells GROUP BY b),
found AS (
  SELECT a.u, a.b, sum(w * (c.r - (v.s - c.r) / (v.n - 1))) / sum(w) AS deviation
  FROM asked a JOIN cells c ON c.b = a.b JOIN pairs p ON p.one = a.u AND p.two = c.u JOIN users v ON v.u = c.u
  GROUP BY a.u, a.b
)
SELECT q.u AS user_id, q.b AS business_id,
       round(CASE WHEN m.n IS NULL THEN 3.72
                  WHEN k > 1 AND deviation IS NOT NULL THEN greatest(1.75, least(4.5, m.s / m.n + deviation))
                  ELSE m.s / m.n END, 6) AS rating
FROM requests q LEFT JOIN users m ON m.u = q.u LEFT JOIN raters ON raters.b = q.b
LEFT JOIN found f ON f.u = q.u AND f.b = q.b""",
)
def cf_user(spark: SparkSession, folder: str) -> DataFrame:
    ratings, requests = _ratings(spark, folder)
    return _rated_answers(recommend.predict_user_based(ratings, requests))


@_register(
    "cf_item",
    f"""
WITH {_RATED}, {_pairs_sql("pairs", "b", "u", "x.b IN (SELECT b FROM requests)")},
asked AS (SELECT DISTINCT u, b FROM requests),
found AS (
  SELECT a.u, a.b, sum(w * c.r) / sum(w) AS estimate, count(*) AS neighbours
  FROM asked a JOIN cells c ON c.u = a.u JOIN pairs p ON p.one = a.b AND p.two = c.b
  GROUP BY a.u, a.b
)
SELECT q.u AS user_id, q.b AS business_id,
       round(CASE WHEN m.n IS NULL THEN 3.72
                  WHEN neighbours > 12 THEN greatest(1.75, least(4.5, estimate))
                  ELSE m.s / m.n END, 6) AS rating
FROM requests q LEFT JOIN items m ON m.b = q.b
LEFT JOIN found f ON f.u = q.u AND f.b = q.b""",
)
def cf_item(spark: SparkSession, folder: str) -> DataFrame:
    ratings, requests = _ratings(spark, folder)
    return _rated_answers(recommend.predict_item_based(ratings, requests))


def _excluding_sql(key: str, by: str) -> str:
    """asked (u, b), and sums: what each asked `key` shares with others of its `by`, without the `by` asked about."""
    other = f"x.{by} <> a.{by}"
    return f"""
asked AS (SELECT DISTINCT u, b FROM requests),
sums AS (
  SELECT a.u, a.b, c.{key} AS two, any_value(c.r) AS r, count(*) FILTER ({other}) AS n,
         sum(x.r) FILTER ({other}) AS sx, sum(y.r) FILTER ({other}) AS sy, sum(x.r * x.r) FILTER ({other}) AS sxx,
         sum(y.r * y.r) FILTER ({other}) AS syy, sum(x.r * y.r) FILTER ({other}) AS sxy
  FROM asked a JOIN cells c ON c.{by} = a.{by} AND c.{key} <> a.{key}
  JOIN cells x ON x.{key} = a.{key} JOIN cells y ON y.{key} = c.{key} AND y.{by} = x.{by}
  GROUP BY 1, 2, 3 HAVING count(*) > 2
),
pairs AS (SELECT u, b, two, r, {_CORRELATION} AS w FROM sums WHERE n * sxy - sx * sy > 0)"""


@_register(
    "cf_user_exclude_self",
    f"""
WITH {_RATED}, {_excluding_sql("u", "b")},
found AS (
  SELECT p.u, p.b, sum(w * (p.r - (v.s - p.r) / (v.n - 1))) / sum(w) AS deviation
  FROM pairs p JOIN users v ON v.u = two GROUP BY p.u, p.b
),
raters AS (
  SELECT a.u, a.b, count(*) FILTER (c.u <> a.u) AS k FROM asked a JOIN cells c ON c.b = a.b GROUP BY a.u, a.b
)
SELECT q.u AS user_id, q.b AS business_id,
       round(CASE WHEN m.n IS NULL THEN 3.72
                  WHEN k > 1 AND deviation IS NOT NULL THEN greatest(1.75, least(4.5, m.s / m.n + deviation))
                  ELSE m.s / m.n END, 6) AS rating
FROM requests q LEFT JOIN users m ON m.u = q.u LEFT JOIN raters k ON k.u = q.u AND k.b = q.b
LEFT JOIN found f ON f.u = q.u AND f.b = q.b""",
)
def cf_user_exclude_self(spark: SparkSession, folder: str) -> DataFrame:
    ratings, requests = _ratings(spark, folder)
    return _rated_answers(recommend.predict_user_based(ratings, requests, exclude_self=True))


@_register(
    "cf_item_exclude_self",
    f"""
WITH {_RATED}, {_excluding_sql("b", "u")},
found AS (SELECT u, b, sum(w * r) / sum(w) AS estimate, count(*) AS neighbours FROM pairs GROUP BY u, b)
SELECT q.u AS user_id, q.b AS business_id,
       round(CASE WHEN m.n IS NULL THEN 3.72
                  WHEN neighbours > 12 THEN greatest(1.75, least(4.5, estimate))
                  ELSE m.s / m.n END, 6) AS rating
FROM requests q LEFT JOIN items m ON m.b = q.b
LEFT JOIN found f ON f.u = q.u AND f.b = q.b""",
)
def cf_item_exclude_self(spark: SparkSession, folder: str) -> DataFrame:
    ratings, requests = _ratings(spark, folder)
    return _rated_answers(recommend.predict_item_based(ratings, requests, exclude_self=True))


@_register("als_predict")
def als_predict(spark: SparkSession, folder: str) -> DataFrame:
    train, requests = _train_and_requests(spark, folder)
    return recommend.predict(train, requests, method=1)


@_register(
    "als_products",
    f"""
WITH {_RATED}
SELECT u AS user_id, b AS business_id,
       u NOT IN (SELECT u FROM train) OR b NOT IN (SELECT b FROM train) AS cold, true AS holds
FROM requests""",
)
def als_products(spark: SparkSession, folder: str) -> DataFrame:
    """Per request, whether the answer is the product of the factors, or the constant where user or item is unseen."""
    train, requests = _train_and_requests(spark, folder)
    found = recommend.als_products(train, requests)
    said = F.coalesce("product", F.lit(recommend.ALS_COLD_START))
    return found.select(
        "user_id", "business_id", F.col("product").isNull().alias("cold"), (F.abs(F.col("rating") - said) < 1e-4).alias("holds")
    )


# --- graph ----------------------------------------------------------------------------------


@_register("co_graph", f"WITH {_GRAPH} SELECT src, dst FROM edges")
def co_graph(spark: SparkSession, folder: str) -> DataFrame:
    return _event_graph(spark, folder)


@_register("degrees", f"WITH {_GRAPH} SELECT src AS node, count(*) AS degree FROM edges GROUP BY src")
def degrees(spark: SparkSession, folder: str) -> DataFrame:
    return graph.degrees(_event_graph(spark, folder))


@_register("shortest_paths", f"WITH RECURSIVE {_PATHS} SELECT root, node, level, sigma FROM paths")
def shortest_paths(spark: SparkSession, folder: str) -> DataFrame:
    found = graph.shortest_path_counts(_event_graph(spark, folder))
    return found.withColumn("sigma", F.col("sigma").cast("long"))


@_register(
    "node_credit",
    f"""
WITH RECURSIVE {_PATHS}
SELECT p.root AS root, p.node AS node, round(sum(p.sigma * q.sigma / t.sigma), 6) AS credit
FROM paths p JOIN paths q ON q.root = p.node
JOIN paths t ON t.root = p.root AND t.node = q.node AND t.level = p.level + q.level
GROUP BY 1, 2""",
)
def node_credit(spark: SparkSession, folder: str) -> DataFrame:
    return graph.node_credit(_event_graph(spark, folder)).withColumn("credit", F.round("credit", 6))


@_register(
    "edge_betweenness",
    f"WITH RECURSIVE {_BETWEENNESS} SELECT src, dst, round(value, 6) AS betweenness FROM betweenness",
)
def edge_betweenness(spark: SparkSession, folder: str) -> DataFrame:
    between = graph.edge_betweenness(_event_graph(spark, folder))
    return between.withColumn("betweenness", F.round("betweenness", 6))


@_register(
    "components",
    f"WITH RECURSIVE {_PATHS} SELECT node, min(root) AS community FROM distances GROUP BY node",
)
def components(spark: SparkSession, folder: str) -> DataFrame:
    edges = _event_graph(spark, folder)
    return graph.components(graph.nodes_of(edges), edges)


@_register(
    "modularity",
    f"""
WITH {_GRAPH},
parts AS (SELECT src AS node, src % 2 AS community FROM edges GROUP BY src),
by_part AS (
  SELECT a.community AS c, count(*) AS d, count(*) FILTER (WHERE a.community = b.community) AS e
  FROM edges JOIN parts a ON a.node = src JOIN parts b ON b.node = dst GROUP BY 1
),
total AS (SELECT count(*) AS m2 FROM edges)
SELECT round(sum(e / m2 - (d / m2) * (d / m2)), 6) AS modularity FROM by_part, total""",
)
def modularity(spark: SparkSession, folder: str) -> DataFrame:
    edges = _event_graph(spark, folder)
    parity = graph.nodes_of(edges).withColumn("community", F.col("node") % 2)
    return graph.modularity(edges, parity).withColumn("modularity", F.round("modularity", 6))


@_register(
    "drop_top_edges",
    f"""
WITH RECURSIVE {_BETWEENNESS},
top AS (SELECT src, dst FROM betweenness
        WHERE round(value, 9) = (SELECT max(round(value, 9)) FROM betweenness))
SELECT src, dst FROM edges WHERE NOT EXISTS (
  SELECT 1 FROM top WHERE top.src = least(edges.src, edges.dst) AND top.dst = greatest(edges.src, edges.dst))""",
)
def drop_top_edges(spark: SparkSession, folder: str) -> DataFrame:
    edges = _event_graph(spark, folder)
    return graph.drop_top_edges(edges, graph.edge_betweenness(edges))


@_register("first_split", f"{_split_sql(1)} SELECT node, community FROM m1")
def first_split(spark: SparkSession, folder: str) -> DataFrame:
    return graph.first_split(_event_graph(spark, folder, COMMUNITY_THRESHOLD))


@_register("communities", _best_split_sql(_SPLIT_ROUNDS))
def communities(spark: SparkSession, folder: str) -> DataFrame:
    return graph.girvan_newman(_event_graph(spark, folder, COMMUNITY_THRESHOLD))


# --- sources and sinks ------------------------------------------------------------------------


@_register(
    "source_json_lines",
    f"""
WITH {_REVIEWS}
SELECT CAST(user_id AS VARCHAR) AS user_id, count(*) AS n, sum(stars) AS stars, CAST(sum(useful) AS BIGINT) AS useful,
       CAST(sum(length(text)) AS BIGINT) AS characters
FROM reviews GROUP BY 1""",
)
def source_json_lines(spark: SparkSession, folder: str) -> DataFrame:
    path = _scratch(spark)
    reviews = _reviews(spark, folder)
    texts = [F.col(c).cast("string") for c in ("user_id", "business_id")]
    writers.write_json(reviews.select(*texts, "stars", "useful", "text"), path)
    return readers.read_json_lines(spark, path, readers.REVIEW).groupBy("user_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("stars").alias("stars"),
        F.sum("useful").alias("useful"),
        F.sum(F.length("text")).alias("characters"),
    )


@_register(
    "source_csv_pairs",
    """
SELECT p_brand AS "left", p_type || ',' || p_name AS "right", count(*) AS n FROM part GROUP BY 1, 2""",
)
def source_csv_pairs(spark: SparkSession, folder: str) -> DataFrame:
    path = _scratch(spark)
    part = _table(spark, folder, "part")
    # Unquoted lines, as another program would leave them: the right value holds a comma.
    part.select(F.concat_ws(",", "p_brand", "p_type", "p_name").alias("brand,rest")).write.option(
        "header", True
    ).option("sep", "\u0001").option("quote", "").csv(path)
    return readers.read_csv_pairs(spark, path).groupBy("left", "right").agg(F.count(F.lit(1)).alias("n"))


@_register(
    "source_csv_fields",
    f"""
WITH {_RATED}
SELECT CAST(b AS VARCHAR) AS business_id, count(*) AS n, sum(stars) AS stars FROM rated GROUP BY 1""",
)
def source_csv_fields(spark: SparkSession, folder: str) -> DataFrame:
    path = _scratch(spark)
    writers.write_csv(_rating_lines(spark, folder).select("user_id", "business_id", "stars"), path)
    return readers.read_csv_fields(spark, path).groupBy("business_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum("stars").alias("stars")
    )


def _placed_lines(spark: SparkSession, path: str, header: str | None = None) -> DataFrame:
    """(line, place): the lines of a folder of text, numbered as the files hold them; headers are at -1, one for all files."""
    lines = readers.with_line_order(spark.read.text(path).withColumnRenamed("value", "line"), "at")
    at_head = F.col("line") == F.lit(header) if header else F.lit(False)
    placed = ids.dense_codes(lines.filter(~at_head), [F.asc("at")], "place").drop("at")
    heads = lines.filter(at_head).groupBy("line").agg(F.lit(-1).cast("long").alias("place"))
    return placed.unionByName(heads)


@_register(
    "sink_averages",
    """
SELECT 'state,stars' AS line, -1 AS place
UNION ALL
SELECT n_name || ',' || CAST(stars AS VARCHAR), row_number() OVER (ORDER BY stars DESC, n_name) - 1 FROM (
  SELECT n_name, CAST(avg(o_totalprice) AS DECIMAL(18, 2)) AS stars
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
  GROUP BY n_name)""",
)
def sink_averages(spark: SparkSession, folder: str) -> DataFrame:
    path = _scratch(spark)
    averages = _state_averages(spark, folder).withColumn("stars", F.col("stars").cast("decimal(18, 2)"))
    writers.write_csv(averages, path, [F.desc("stars"), "state"])
    return _placed_lines(spark, path, "state,stars")


@_register(
    "sink_itemsets",
    _SON
    + """
SELECT kind, size, '["' || replace(items, ',', '","') || '"]' AS items, freq FROM report""",
)
def sink_itemsets(spark: SparkSession, folder: str) -> DataFrame:
    path = _scratch(spark)
    items = _chunked_items(spark, folder)
    writers.write_itemsets(baskets.itemset_report(items, _support(items)), path)
    schema = "kind string, size int, items string, freq bigint"
    return spark.read.schema(schema).option("header", True).option("escape", '"').csv(path)


@_register(
    "sink_edge_betweenness",
    f"""
WITH RECURSIVE {_BETWEENNESS}
SELECT src, dst, round(value, 6) AS betweenness FROM betweenness""",
)
def sink_edge_betweenness(spark: SparkSession, folder: str) -> DataFrame:
    path = _scratch(spark)
    writers.write_edge_betweenness(edge_betweenness(spark, folder), path)
    schema = "src bigint, dst bigint, betweenness double"
    return spark.read.schema(schema).option("header", True).csv(path)


@_register(
    "sink_communities",
    f"""
WITH RECURSIVE {_PATHS},
members AS (SELECT node, min(root) AS community FROM distances GROUP BY node),
sized AS (SELECT count(*) OVER (PARTITION BY community) AS size, community, node FROM members)
SELECT 'size,community,node' AS line, -1 AS place
UNION ALL
SELECT size || ',' || community || ',' || node, row_number() OVER (ORDER BY size, community, node) - 1 FROM sized""",
)
def sink_communities(spark: SparkSession, folder: str) -> DataFrame:
    path = _scratch(spark)
    writers.write_communities(components(spark, folder), path)
    return _placed_lines(spark, path, "size,community,node")


@_register(
    "sink_community_lines",
    f"""
WITH RECURSIVE {_PATHS},
members AS (SELECT node, min(root) AS community FROM distances GROUP BY node)
SELECT string_agg(CAST(node AS VARCHAR), ', ' ORDER BY node) AS line,
       row_number() OVER (ORDER BY count(*), community) - 1 AS place
FROM members GROUP BY community""",
)
def sink_community_lines(spark: SparkSession, folder: str) -> DataFrame:
    path = _scratch(spark)
    writers.write_communities(components(spark, folder), path, lines=True)
    return _placed_lines(spark, path)


# --- the method switch, and the sinks of predictions, pairs and statistics -------------


@_register("predict_user", SQL["cf_user"])
def predict_user(spark: SparkSession, folder: str) -> DataFrame:
    train, requests = _train_and_requests(spark, folder)
    return _rated_answers(recommend.predict(train, requests, method=2, order_by=_RATED_ORDER))


@_register("predict_item", SQL["cf_item"])
def predict_item(spark: SparkSession, folder: str) -> DataFrame:
    train, requests = _train_and_requests(spark, folder)
    return _rated_answers(recommend.predict(train, requests, method=3, order_by=_RATED_ORDER))


@_register(
    "als_cold_start",
    f"""
WITH {_RATED}
SELECT count(*) AS requests,
       count(*) FILTER (WHERE u NOT IN (SELECT u FROM train) OR b NOT IN (SELECT b FROM train)) AS cold
FROM requests""",
)
def als_cold_start(spark: SparkSession, folder: str) -> DataFrame:
    train, requests = _train_and_requests(spark, folder)
    predicted = recommend.predict(train, requests, method=1)
    return predicted.agg(
        F.count(F.lit(1)).alias("requests"), F.count_if(F.col("rating") == recommend.ALS_COLD_START).alias("cold")
    )


@_register(
    "als_equations",
    f"WITH {_RATED} SELECT CAST(u AS VARCHAR) AS user_id, count(*) AS n, true AS holds FROM train GROUP BY u",
)
def als_equations(spark: SparkSession, folder: str) -> DataFrame:
    train, _ = _train_and_requests(spark, folder)
    found = recommend.als_residuals(train)
    return found.select("user_id", "n", (F.col("residual") < 1e-4).alias("holds"))


@_register(
    "sink_predictions", f"SELECT CAST(user_id AS VARCHAR) AS user_id, CAST(business_id AS VARCHAR) AS business_id, rating FROM ({SQL['cf_item']})"
)
def sink_predictions(spark: SparkSession, folder: str) -> DataFrame:
    path = _scratch(spark)
    writers.write_csv(cf_item(spark, folder), path)
    schema = "user_id string, business_id string, rating double"
    return spark.read.schema(schema).option("header", True).csv(path)


@_register(
    "sink_similar_pairs",
    f"SELECT id_1, id_2, similarity, row_number() OVER (ORDER BY id_1, id_2) - 1 AS place FROM ({SQL['jaccard_exact']})",
)
def sink_similar_pairs(spark: SparkSession, folder: str) -> DataFrame:
    path = _scratch(spark)
    writers.write_csv(jaccard_exact(spark, folder), path, ["id_1", "id_2"])
    schema = "id_1 bigint, id_2 bigint, similarity double"
    lines = readers.with_line_order(spark.read.schema(schema).option("header", True).csv(path), "line")
    return ids.dense_codes(lines, [F.asc("line")], "place").drop("line")


@_register("sink_statistics", SQL["review_summary"])
def sink_statistics(spark: SparkSession, folder: str) -> DataFrame:
    path = _scratch(spark)
    writers.write_json(review_summary(spark, folder), path)
    schema = (
        "n_review_useful bigint, n_review_5_star bigint, n_characters bigint, n_user bigint, top20_user string, "
        "n_business bigint, top20_business string"
    )
    return readers.read_json_lines(spark, path, _parsed(schema))


def _parsed(schema: str) -> T.StructType:
    return T.StructType.fromDDL(schema)


@_register(
    "source_literal",
    "SELECT o_orderstatus AS status, count(*) AS n FROM orders WHERE o_orderstatus IN ('F', 'O', 'P') GROUP BY 1",
)
def source_literal(spark: SparkSession, folder: str) -> DataFrame:
    wanted = readers.literal_lines(spark, ["F", "O", "P"]).select(F.col("value").alias("o_orderstatus"))
    orders = _table(spark, folder, "orders").select("o_orderstatus")
    return stats.count_per_key(orders.join(wanted, "o_orderstatus"), "o_orderstatus").withColumnRenamed(
        "o_orderstatus", "status"
    )
