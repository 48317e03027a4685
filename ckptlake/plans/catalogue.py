"""The library's queries over the driver's tables, and the same in SQL.

Roles of the tables: ``documents`` are objects, ``events`` a commit log in the
order of event_id, ``lineitem`` chunks of rows, ``orders`` snapshots to compare
and merge, ``embeddings`` the rows of a weight matrix, ``part`` and the geography
layers and links. Each query calls the operators that the checkpoint path uses.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ckptlake import ship
from ckptlake.functions import bits, exprs
from ckptlake.operators import dag, relational

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return put


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _round(c, places: int = 6):
    return F.round(c, places)


@query("SELECT sha256(text) AS object, count(*) AS n_refs, min(doc_id) AS first_ref FROM documents GROUP BY 1")
def content_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.content_dedup(_read(spark, sf_dir, "documents"), F.col("text"), F.col("doc_id"))


@query("""SELECT source, count(*) AS n, CAST(sum(strlen(text)) AS BIGINT) AS original_bytes, CAST(sum(CASE WHEN rn = 1 THEN strlen(text) ELSE 0 END) AS BIGINT) AS stored_bytes,
  round(sum(CASE WHEN rn = 1 THEN strlen(text) ELSE 0 END) / sum(strlen(text)), 6) AS ratio
  FROM (SELECT *, row_number() OVER (PARTITION BY sha256(text) ORDER BY doc_id) AS rn FROM documents) GROUP BY source""")
def encode_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "source", F.octet_length("text").alias("size"), F.sha2("text", 256).alias("object"))
    first = docs.groupBy("object").agg(F.min("doc_id").alias("doc_id")).select("doc_id", F.lit(True).alias("first"))
    marked = docs.join(first, "doc_id", "left")
    stored = F.sum(F.when(F.col("first"), F.col("size")).otherwise(0))
    return marked.groupBy("source").agg(F.count("*").alias("n"), F.sum("size").alias("original_bytes"), stored.alias("stored_bytes"), _round(F.try_divide(stored, F.sum("size"))).alias("ratio"))


@query("""SELECT event_id // 128 AS chunk_no, count(*) AS n_rows, min(event_id) AS row_start, max(event_id) AS row_end,
  sha256(string_agg(CAST(user_id AS VARCHAR) || ':' || event_type, '|' ORDER BY event_id)) AS content_hash FROM events GROUP BY 1""")
def chunk_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "events").withColumn("chunk_no", F.floor(F.col("event_id") / 128))
    return relational.chunk_hash(rows, ["chunk_no"], F.concat(F.col("user_id").cast("string"), F.lit(":"), "event_type"), "event_id")


@query("""SELECT l_returnflag, count(*) AS n, CAST(sum(CASE WHEN z >= 255 THEN 1 ELSE 0 END) AS BIGINT) AS n_escaped, round(avg(CASE WHEN z >= 255 THEN 1.0 ELSE 0.0 END), 6) AS escape_rate, CAST(sum(z) AS BIGINT) AS zigzag_sum,
  bool_and(((l_suppkey + (((z >> 1) # CASE WHEN z & 1 = 1 THEN 65535 ELSE 0 END))) & 65535) = (l_partkey & 65535)) AS exact
  FROM (SELECT *, xor((d * 2) & 65535, CASE WHEN d >= 32768 THEN 65535 ELSE 0 END) AS z FROM (SELECT *, (l_partkey - l_suppkey) & 65535 AS d FROM lineitem)) GROUP BY 1""".replace("(z >> 1) # CASE WHEN z & 1 = 1 THEN 65535 ELSE 0 END", "xor(z >> 1, CASE WHEN z & 1 = 1 THEN 65535 ELSE 0 END)"))
def zigzag_escape_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = _read(spark, sf_dir, "lineitem").select("l_returnflag", "l_partkey", "l_suppkey")
    z = li.withColumn("z", exprs.zigzag16(exprs.delta16(F.col("l_partkey"), F.col("l_suppkey"))))
    back = exprs.add16(F.col("l_suppkey"), exprs.unzigzag16(F.col("z"))) == F.col("l_partkey").bitwiseAND(exprs.MASK)
    return z.groupBy("l_returnflag").agg(F.count("*").alias("n"), F.count_if(exprs.escapes(F.col("z"))).alias("n_escaped"), _round(F.avg(exprs.escapes(F.col("z")).cast("double"))).alias("escape_rate"), F.sum("z").alias("zigzag_sum"), F.bool_and(back).alias("exact"))


_SNAPSHOTS = """o AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 5 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS v FROM orders WHERE o_orderkey % 11 <> 0),
  t AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 7 = 0 THEN o_totalprice + 2 ELSE o_totalprice END AS v FROM orders WHERE o_orderkey % 13 <> 0),
  b AS (SELECT o_orderkey AS k, o_totalprice AS v FROM orders WHERE o_orderkey % 17 <> 0)"""
_PLAN = f"""{_SNAPSHOTS}, p AS (SELECT coalesce(o.k, t.k) AS k, o.v AS o, t.v AS t, b.v AS b,
  CASE WHEN o.k IS NULL THEN 'only-theirs' WHEN t.k IS NULL THEN 'only-ours' WHEN o.v = t.v THEN 'unchanged' WHEN o.v IS NOT DISTINCT FROM b.v THEN 'take-theirs' WHEN t.v IS NOT DISTINCT FROM b.v THEN 'take-ours' ELSE 'averaged' END AS action
  FROM o FULL JOIN t ON o.k = t.k LEFT JOIN b ON b.k = coalesce(o.k, t.k))"""


def _snapshots(spark, sf_dir):
    orders = _read(spark, sf_dir, "orders")
    k, v = F.col("o_orderkey"), F.col("o_totalprice")
    return (
        orders.where(k % 11 != 0).select(k.alias("k"), F.when(k % 5 == 0, v + 1).otherwise(v).alias("v")),
        orders.where(k % 13 != 0).select(k.alias("k"), F.when(k % 7 == 0, v + 2).otherwise(v).alias("v")),
        orders.where(k % 17 != 0).select(k.alias("k"), v.alias("v")),
    )


@query(f"WITH {_PLAN} SELECT action, count(*) AS n FROM p GROUP BY action")
def merge_plan_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.merge_plan(*_snapshots(spark, sf_dir), "k", "v").groupBy("action").agg(F.count("*").alias("n"))


@query(f"""WITH {_PLAN} SELECT k, action, round(CASE WHEN action IN ('only-theirs', 'take-theirs') THEN t WHEN action <> 'averaged' THEN o WHEN k % 2 = 0 THEN o ELSE (o + t) / 2 END, 4) AS merged FROM p""")
def merge_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = relational.merge_plan(*_snapshots(spark, sf_dir), "k", "v")
    return relational.merge_average(plan, "o", "t", F.col("k") % 2 == 0).select("k", "action", _round("merged", 4).alias("merged"))


@query(f"""WITH {_SNAPSHOTS}, c AS (SELECT coalesce(o.k, t.k) AS k, CASE WHEN o.k IS NULL THEN 'missing_left' WHEN t.k IS NULL THEN 'missing_right' WHEN o.v IS NOT DISTINCT FROM t.v THEN 'equal' ELSE 'mismatched' END AS status, abs(o.v - t.v) AS diff FROM o FULL JOIN t ON o.k = t.k)
  SELECT status, count(*) AS n, round(max(diff), 4) AS max_diff, round(sum(diff) / count(diff), 4) AS mean_diff FROM c GROUP BY status""")
def compare_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    ours, theirs, _ = _snapshots(spark, sf_dir)
    return relational.compare_sources(ours, theirs, "k", "v").groupBy("status").agg(F.count("*").alias("n"), _round(F.max("diff"), 4).alias("max_diff"), _round(F.avg("diff"), 4).alias("mean_diff"))


def _edges(events: DataFrame) -> DataFrame:
    """A commit graph of the whole log: a branch for each user, which forks from the commit before its first one; every tenth commit of a branch also merges the seventh before."""
    w = Window.partitionBy("user_id").orderBy("event_id")
    own = events.select(F.col("event_id").alias("child"), F.lag("event_id").over(w).alias("before"), F.lag("event_id", 7).over(w).alias("seventh"), F.row_number().over(w).alias("n"))
    first = own.select("child", F.coalesce("before", F.col("child") - 1).alias("parent"), F.lit(0).alias("ord")).where("parent >= 0")
    return first.unionByName(own.where("n % 10 = 0 and seventh is not null").select("child", F.col("seventh").alias("parent"), F.lit(1).alias("ord")))


def _tips(events: DataFrame) -> DataFrame:
    return events.groupBy("user_id").agg(F.max("event_id").alias("node"))


_LINKS = """l AS (SELECT event_id AS child, lag(event_id) OVER w AS b, lag(event_id, 7) OVER w AS s, row_number() OVER w AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
  e AS (SELECT child, coalesce(b, child - 1) AS parent, 0 AS ord FROM l WHERE coalesce(b, child - 1) >= 0 UNION ALL SELECT child, s, 1 FROM l WHERE n % 10 = 0 AND s IS NOT NULL)"""
_EDGES = _LINKS + """, tips AS (SELECT user_id, max(event_id) AS node FROM events GROUP BY 1),
  a AS (SELECT node AS root, node, 0 AS depth FROM tips UNION SELECT a.root, e.parent, a.depth + 1 FROM a JOIN e ON e.child = a.node),
  near AS (SELECT root, node, min(depth) AS depth FROM a GROUP BY 1, 2)"""


@query(f"WITH RECURSIVE {_EDGES} SELECT root, node, depth FROM near")
def ancestors_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _read(spark, sf_dir, "events").select("event_id", "user_id")
    return dag.ancestors(_edges(events), _tips(events).select("node"))


@query("""WITH RECURSIVE l AS (SELECT event_id AS child, coalesce(lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id), event_id - 1) AS parent FROM events),
  c AS (SELECT max(event_id) AS node, 0 AS depth FROM events UNION ALL SELECT l.parent, c.depth + 1 FROM c JOIN l ON l.child = c.node WHERE c.depth < 24 AND l.parent >= 0)
  SELECT c.depth, c.node, e.event_type AS label FROM c LEFT JOIN events e ON e.event_id = c.node""")
def log_first_parent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last 25 commits of the newest branch, which is what a log with a limit is."""
    events = _read(spark, sf_dir, "events")
    log = dag.first_parents(_edges(events.select("event_id", "user_id")), events.agg(F.max("event_id")).first()[0], 25)
    return log.join(events.select(F.col("event_id").alias("node"), F.col("event_type").alias("label")), "node", "left").select("depth", "node", "label")


@query(f"""WITH RECURSIVE {_EDGES}, p AS (SELECT * FROM (SELECT node AS ours, lead(node) OVER (ORDER BY user_id) AS theirs FROM tips) WHERE theirs IS NOT NULL)
  SELECT ours, theirs, x.node, x.depth AS ours_depth, y.depth AS theirs_depth FROM p JOIN near x ON x.root = ours JOIN near y ON y.root = theirs AND y.node = x.node
  QUALIFY row_number() OVER (PARTITION BY ours, theirs ORDER BY x.depth + y.depth, x.node) = 1""")
def merge_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merge bases of the branches of each user and the next; the tips are one row a branch."""
    events = _read(spark, sf_dir, "events").select("event_id", "user_id")
    pairs = _tips(events).select(F.col("node").alias("ours"), F.lead("node").over(Window.orderBy("user_id")).alias("theirs")).where("theirs is not null")
    return dag.merge_bases(_edges(events), dag.cut(pairs))


@query("""SELECT event_id, user_id, CAST(row_number() OVER (PARTITION BY user_id, star ORDER BY event_id) - 1 AS BIGINT) AS since_full, anchor FROM (
  SELECT event_id, user_id, sum(CASE WHEN event_id % 4 = 0 THEN 1 ELSE 0 END) OVER w AS star, last_value(CASE WHEN event_id % 4 = 0 THEN event_id END IGNORE NULLS) OVER w AS anchor
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING))""")
def star_anchor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.star_anchors(_read(spark, sf_dir, "events").select("event_id", "user_id"), "user_id", "event_id", F.col("event_id") % 4 == 0).select("event_id", "user_id", "since_full", "anchor")


@query("""WITH s AS (SELECT o_orderkey // 100 AS chunk_no, min(o_orderkey) AS row_start, max(o_orderkey) AS row_end, count(*) AS n_rows FROM orders GROUP BY 1)
  SELECT l_orderkey, count(*) AS n_refs, any_value(chunk_no) AS chunk_no, any_value(row_start) AS row_start, any_value(n_rows) AS n_rows FROM lineitem JOIN s ON l_orderkey BETWEEN row_start AND row_end GROUP BY 1""")
def interval_gather(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = _read(spark, sf_dir, "orders").groupBy(F.floor(F.col("o_orderkey") / 100).alias("chunk_no")).agg(F.min("o_orderkey").alias("row_start"), F.max("o_orderkey").alias("row_end"), F.count("*").alias("n_rows"))
    wanted = _read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n_refs"))
    return relational.interval_gather(wanted, "l_orderkey", chunks, 100).where("l_orderkey between row_start and row_end").select("l_orderkey", "n_refs", "chunk_no", "row_start", "n_rows")


@query("""SELECT vec_id, CAST(list_sum(list_transform(range(1, 65), lambda i: (CAST(CAST(embedding[i] AS BIT) AS INTEGER)::BIGINT & 4294967295) * i)) AS BIGINT) AS checksum,
  CAST(CAST(embedding[1] AS BIT) AS INTEGER)::BIGINT & 4294967295 AS first_bits FROM embeddings""")
def float_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "embeddings").select("vec_id", bits.float_bits("embedding").alias("b"))
    total = F.aggregate(F.transform("b", lambda x, i: x * (i + 1)), F.lit(0).cast("long"), lambda s, x: s + x)
    return rows.select("vec_id", total.alias("checksum"), F.element_at("b", 1).alias("first_bits"))


@query("""WITH s AS (SELECT a.label, a.vec_id AS i, b.vec_id AS j, list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS score FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id)
  SELECT label, i, round(max(score), 6) AS best_score, round(sum(score), 4) AS score_sum FROM s GROUP BY 1, 2""")
def group_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of the units of each group with each other, as one product of matrices a group: each unit's best and sum. A label is a layer, whose width bounds the group; no pair leaves the product."""
    import pyarrow as pa

    from ckptlake.operators import align

    def scores(table: pa.Table) -> pa.Table:
        import numpy as np

        m = np.array(table["embedding"].to_pylist(), np.float32).astype(np.float64)
        s = align.unit_scores([("row", 1, m, m)], len(m), normalise=False)
        np.fill_diagonal(s, -np.inf)
        best = s.max(1)
        np.fill_diagonal(s, 0)
        return pa.table({"label": table["label"].cast(pa.int32()), "i": table["vec_id"], "best_score": best, "score_sum": s.sum(1)})

    got = _read(spark, sf_dir, "embeddings").select("label", "vec_id", "embedding").groupBy("label").applyInArrow(scores, "label int, i long, best_score double, score_sum double")
    return got.where("best_score > double('-infinity')").select("label", "i", _round("best_score").alias("best_score"), _round("score_sum", 4).alias("score_sum"))


@query("""SELECT l_linestatus, CAST(sum(n) AS BIGINT) AS total, round(-sum(n / t * log2(n / t)), 6) AS entropy FROM (SELECT l_linestatus, l_partkey & 255 AS b, count(*)::DOUBLE AS n, sum(count(*)) OVER (PARTITION BY l_linestatus) AS t FROM lineitem GROUP BY 1, 2) GROUP BY 1""")
def byte_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "lineitem").select("l_linestatus", F.col("l_partkey").bitwiseAND(255).alias("b"))
    return relational.entropy(rows, ["l_linestatus"], "b").select("l_linestatus", "total", _round("entropy").alias("entropy"))


@query("""WITH p AS (SELECT event_type AS b, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS a FROM events), n AS (SELECT a, b, count(*)::DOUBLE AS n FROM p WHERE a IS NOT NULL GROUP BY 1, 2), m AS (SELECT *, sum(n) OVER (PARTITION BY a) AS m FROM n)
  SELECT CAST(sum(n) AS BIGINT) AS n_pairs, round(sum(n * log2(m / n)) / sum(n), 6) AS entropy FROM m""")
def cond_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.conditional_entropy(_read(spark, sf_dir, "events"), "user_id", "event_id", "event_type").select("n_pairs", _round("entropy").alias("entropy"))


@query("""WITH s AS (SELECT user_id, event_id, sign(value - lag(value) OVER (PARTITION BY user_id ORDER BY event_id)) AS g FROM events), m AS (SELECT *, CASE WHEN g = lag(g) OVER (PARTITION BY user_id ORDER BY event_id) THEN 0 ELSE 1 END AS x FROM s WHERE g IS NOT NULL),
  r AS (SELECT user_id, run, count(*) AS n FROM (SELECT *, sum(x) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS run FROM m) GROUP BY 1, 2)
  SELECT user_id, count(*) AS n_runs, round(avg(n), 6) AS mean_length, round(avg(CASE WHEN n >= 8 THEN 1.0 ELSE 0.0 END), 6) AS long_share FROM r GROUP BY 1""")
def sign_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = relational.sign_runs(_read(spark, sf_dir, "events"), "user_id", "event_id", "value")
    return runs.select("user_id", "n_runs", _round("mean_length").alias("mean_length"), _round("long_share").alias("long_share"))


@query("""WITH b AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(CAST(x AS BIT) AS INTEGER)::BIGINT & 4294967295) AS b FROM embeddings),
  p AS (SELECT label, unnest(list_transform(list_zip(b, pb), lambda z: (z[1] - z[2]) & 4294967295)) AS d FROM (SELECT *, lag(b) OVER (PARTITION BY label ORDER BY vec_id) AS pb FROM b) WHERE pb IS NOT NULL)
  SELECT label, count(*) AS n, CAST(sum(CASE WHEN d = 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_zero, median(least(d, 4294967296 - d)) AS median_step, round(avg(CASE WHEN least(d, 4294967296 - d) < 8388608 THEN 1.0 ELSE 0.0 END), 6) AS small_share FROM p GROUP BY 1""")
def bit_delta_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "embeddings").select("vec_id", "label", bits.float_bits("embedding").alias("b"))
    before = F.lag("b").over(Window.partitionBy("label").orderBy("vec_id"))
    d = rows.withColumn("pb", before).where("pb is not null").select("label", F.explode(F.zip_with("b", "pb", lambda x, y: (x - y).bitwiseAND(4294967295))).alias("d"))
    step = F.least(F.col("d"), F.lit(4294967296) - F.col("d"))
    return d.groupBy("label").agg(F.count("*").alias("n"), F.count_if(F.col("d") == 0).alias("n_zero"), F.median(step).alias("median_step"), _round(F.avg((step < 8388608).cast("double"))).alias("small_share"))


@query("""WITH l AS (SELECT user_id, event_id, 16 + event_id % 7 AS size FROM events), s AS (SELECT *, CAST(sum(size) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) - size + CASE WHEN event_id % 50 = 0 THEN 1 ELSE 0 END AS BIGINT) AS b FROM l)
  SELECT user_id, event_id, b AS seg_begin, expected FROM (SELECT *, lag(b + size, 1, 0) OVER (PARTITION BY user_id ORDER BY b, b + size) AS expected FROM s) WHERE expected <> b""")
def tiling_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized = _read(spark, sf_dir, "events").select("user_id", "event_id", (F.col("event_id") % 7 + 16).alias("size"))
    w = Window.partitionBy("user_id").orderBy("event_id").rowsBetween(Window.unboundedPreceding, 0)
    laid = sized.withColumn("seg_begin", F.sum("size").over(w) - F.col("size") + F.when(F.col("event_id") % 50 == 0, 1).otherwise(0)).withColumn("seg_end", F.col("seg_begin") + F.col("size"))
    return relational.tiling_violations(laid, "user_id", "seg_begin", "seg_end").select("user_id", "event_id", "seg_begin", "expected")


@query("""SELECT l_shipmode_like AS grp, CAST(sum(n) AS BIGINT) AS n_refs, CAST(sum(s) AS BIGINT) AS original_bytes, count(*) AS n_objects, CAST(sum(o) AS BIGINT) AS stored_bytes FROM (SELECT l_returnflag AS l_shipmode_like, l_partkey AS obj, count(*) AS n, sum(l_linenumber * 100) AS s, min(l_linenumber * 100) AS o FROM lineitem GROUP BY 1, 2) GROUP BY 1""")
def checkpoint_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    refs = _read(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("grp"), F.col("l_partkey").alias("obj"), (F.col("l_linenumber") * 100).cast("long").alias("size"))
    return relational.checkpoint_sizes(refs, "grp", "obj", "size")


@query("""WITH p AS (SELECT label, embedding::DOUBLE[] AS t, lag(embedding::DOUBLE[]) OVER (PARTITION BY label ORDER BY vec_id) AS b FROM embeddings), x AS (SELECT label, unnest(list_zip(t, b)) AS z FROM p WHERE b IS NOT NULL)
  SELECT label, round(sqrt(sum((z[1] - z[2]) * (z[1] - z[2]))) / sqrt(sum(z[1] * z[1])), 6) AS residual FROM x GROUP BY 1""")
def residual_norms(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _read(spark, sf_dir, "embeddings")
    pairs = v.select("label", F.col("embedding").alias("t"), F.lag("embedding").over(Window.partitionBy("label").orderBy("vec_id")).alias("b")).where("b is not null")
    return relational.residual_norms(pairs, "label", "t", "b").select("label", _round("residual").alias("residual"))


@query("""WITH a AS (SELECT p_brand AS grp, p_size::DOUBLE AS pre, (p_partkey % 50)::DOUBLE AS post, 10.0::DOUBLE AS n FROM part), s AS (SELECT grp, CASE WHEN pre > 0 AND post > 0 THEN n * greatest(-8, least(8, ln(post / pre))) WHEN pre > 0 AND post = 0 THEN -8 * n WHEN pre = 0 AND post > 0 THEN 8 * n END AS d FROM a)
  SELECT grp, round(coalesce(sum(d), 0), 6) AS bit_delta, count(d) AS usable, count(d) > 0 AND coalesce(sum(d), 0) < -1e-6 AS helped FROM s GROUP BY 1""")
def group_bit_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _read(spark, sf_dir, "part").select(F.col("p_brand").alias("grp"), F.col("p_size").cast("double").alias("pre"), (F.col("p_partkey") % 50).cast("double").alias("post"), F.lit(10.0).alias("n"))
    return relational.group_bit_delta(a, "grp", "pre", "post", "n").select("grp", _round("bit_delta").alias("bit_delta"), "usable", "helped")


@query("SELECT CASE WHEN l_discount * 10 >= 0.9 OR l_linenumber >= 3 THEN 'anchor' ELSE 'delta' END AS decision, l_linenumber AS depth, count(*) AS n FROM lineitem GROUP BY 1, 2")
def anchor_decide(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = _read(spark, sf_dir, "lineitem").select((F.col("l_discount") * 10).alias("ratio"), F.col("l_linenumber").alias("depth"))
    return li.select(exprs.anchor_decision(F.col("ratio"), F.col("depth")).alias("decision"), "depth").groupBy("decision", "depth").agg(F.count("*").alias("n"))


@query("""WITH n AS (SELECT count(*) AS n FROM embeddings), p AS (SELECT vec_id AS target_idx, (vec_id * 7) % n AS base_idx FROM embeddings, n)
  SELECT target_idx, base_idx, label, round(list_dot_product(flatten(list_transform([3, 1, 0, 2], lambda k: embedding[k * 16 + 1:k * 16 + 16]))::DOUBLE[], list_transform(range(1, 65), lambda i: i::DOUBLE)), 6) AS weighted FROM p JOIN embeddings ON vec_id = base_idx""")
def permuted_gather(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _read(spark, sf_dir, "embeddings")
    n = v.count()
    perm = v.select(F.col("vec_id").alias("target_idx"), (F.col("vec_id") * 7 % n).alias("base_idx"))
    got = relational.permuted_gather(v, "vec_id", perm, ["label", "embedding"])
    row = exprs.col_permute(F.col("embedding"), F.array(*map(F.lit, (3, 1, 0, 2))), 16)
    total = F.aggregate(F.transform(row, lambda x, i: x.cast("double") * (i + 1)), F.lit(0.0), lambda s, x: s + x)
    return got.select("target_idx", "base_idx", "label", _round(total).alias("weighted"))


@query("""WITH n AS (SELECT count(*) AS n FROM embeddings), f AS (SELECT vec_id AS idx, (vec_id * 7) % n AS val FROM embeddings, n), s AS (SELECT vec_id AS idx, (vec_id * 3 + 1) % n AS val FROM embeddings, n), c AS (SELECT s.idx, f.val FROM s JOIN f ON f.idx = s.val)
  SELECT count(*) AS n, count(DISTINCT val) AS n_distinct, CAST(sum(idx * val) AS BIGINT) AS moment, CAST(sum(CASE WHEN idx = val THEN 1 ELSE 0 END) AS BIGINT) AS fixed, (SELECT count(*) FROM (SELECT val FROM c GROUP BY val HAVING count(*) > 1)) AS problems FROM c""")
def permutation_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("idx"))
    n = v.count()
    both = relational.compose(v.withColumn("val", F.col("idx") * 7 % n), v.withColumn("val", (F.col("idx") * 3 + 1) % n))
    out = both.agg(F.count("*").alias("n"), F.count_distinct("val").alias("n_distinct"), F.sum(F.col("idx") * F.col("val")).alias("moment"), F.count_if(F.col("idx") == F.col("val")).alias("fixed"))
    return out.join(relational.permutation_problems(both, n).agg(F.count("*").alias("problems")))


@query("""WITH h AS (SELECT sha256(text) AS object, min(doc_id) AS first_doc FROM documents GROUP BY 1) SELECT object, first_doc FROM h WHERE object NOT IN (SELECT sha256(text) FROM documents WHERE doc_id % 3 = 0)""")
def want_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("object"))
    mine = docs.groupBy("object").agg(F.min("doc_id").alias("first_doc"))
    return relational.absent(mine, docs.where("doc_id % 3 = 0"))


@query("""SELECT kind, count(*) AS n, CAST(sum(doc_id) AS BIGINT) AS id_sum FROM (SELECT doc_id, CASE WHEN doc_id % 101 = 0 THEN 'missing' WHEN doc_id % 97 = 0 THEN 'checksum-mismatch' WHEN doc_id % 89 = 0 THEN 'content-mismatch' END AS kind FROM documents) WHERE kind IS NOT NULL GROUP BY 1""")
def verify_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects of one document each, some gone, some changed below a checksum that is that of the original, some below one that is their own."""
    docs = _read(spark, sf_dir, "documents").select("doc_id", F.concat(F.col("doc_id").cast("string"), F.lit(":"), "text").cast("binary").alias("own"))
    i = F.col("doc_id")
    changed = F.concat(F.col("own"), F.lit("!").cast("binary"))
    refs = docs.select("doc_id", F.sha2("own", 256).alias("object"), F.when((i % 89 == 0) & (i % 97 != 0), F.substring(F.sha2(changed, 256), 1, 16)).otherwise(F.substring(F.sha2("own", 256), 1, 16)).alias("checksum"))
    stored = docs.where(i % 101 != 0).select(F.sha2("own", 256).alias("object"), F.when((i % 97 == 0) | (i % 89 == 0), changed).otherwise(F.col("own")).alias("payload"))
    return relational.verify_objects(refs, stored).groupBy("kind").agg(F.count("*").alias("n"), F.sum("doc_id").alias("id_sum"))


@query("""WITH l AS (SELECT s_suppkey, s_nationkey, n_regionkey FROM supplier JOIN nation ON s_nationkey = n_nationkey) SELECT s_suppkey AS node, min(s_suppkey) OVER (PARTITION BY n_regionkey) AS label FROM l""")
def connected_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers joined through a chain of nations of their region."""
    s = _read(spark, sf_dir, "supplier").join(_read(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "n_regionkey")
    w = Window.partitionBy("n_regionkey").orderBy(F.xxhash64("s_suppkey"))
    edges = s.select(F.col("s_suppkey").alias("a"), F.lag("s_suppkey").over(w).alias("b")).where("b is not null")
    return dag.components(edges, s.select(F.col("s_suppkey").alias("node"))).select("node", "label")


@query("""WITH l AS (SELECT DISTINCT p_size AS s FROM part) SELECT CAST(a.s AS VARCHAR) AS consumer, CAST(b.s AS VARCHAR) AS producer FROM l a JOIN l b ON a.s <> b.s AND b.s > 0 AND a.s % b.s = 0""")
def theta_can_follow(spark: SparkSession, sf_dir: str) -> DataFrame:
    layers = _read(spark, sf_dir, "part").select(F.col("p_size").alias("cols")).distinct().select(F.col("cols").cast("string").alias("name"), "cols", F.col("cols").alias("out"))
    return relational.can_follow(layers)


@query("""WITH n AS (SELECT 'net.' || lower(replace(p_brand, '#', '.')) || '.n' || p_partkey AS name, p_partkey // 20 AS width, p_partkey AS pos FROM part WHERE p_partkey % 2 = 0), l AS (SELECT 'net.' || lower(replace(p_brand, '#', '.')) || '.l' || p_partkey AS name, p_partkey // 20 AS width, p_partkey AS pos FROM part WHERE p_partkey % 2 = 1),
  j AS (SELECT n.name AS norm, l.name AS host, CASE WHEN split_part(n.name, '.', 1) <> split_part(l.name, '.', 1) THEN 0 WHEN split_part(n.name, '.', 2) <> split_part(l.name, '.', 2) THEN 1 WHEN split_part(n.name, '.', 3) <> split_part(l.name, '.', 3) OR split_part(n.name, '.', 4) = '' OR split_part(l.name, '.', 4) = '' THEN CASE WHEN split_part(n.name, '.', 3) = split_part(l.name, '.', 3) THEN 3 ELSE 2 END WHEN split_part(n.name, '.', 4) <> split_part(l.name, '.', 4) THEN 3 ELSE 4 END AS prefix,
   CASE WHEN regexp_extract(n.name, '(\\d+)$', 1)::BIGINT = regexp_extract(l.name, '(\\d+)$', 1)::BIGINT THEN 1 ELSE 0 END AS same, CASE WHEN n.pos > l.pos THEN 1 ELSE 0 END AS behind, abs(n.pos - l.pos) AS gap FROM n JOIN l ON n.width = l.width)
  SELECT norm, host, prefix FROM j QUALIFY row_number() OVER (PARTITION BY norm ORDER BY prefix DESC, same DESC, behind DESC, gap, host) = 1""")
def best_host(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = _read(spark, sf_dir, "part")
    name = lambda mark: F.concat(F.lit("net."), F.lower(F.replace(F.col("p_brand"), F.lit("#"), F.lit("."))), F.lit(f".{mark}"), F.col("p_partkey").cast("string"))
    norms = part.where("p_partkey % 2 = 0").select(name("n").alias("name"), F.floor(F.col("p_partkey") / 20).alias("width"), F.col("p_partkey").alias("pos"))
    layers = part.where("p_partkey % 2 = 1").select(name("l").alias("name"), F.floor(F.col("p_partkey") / 20).alias("width"), F.col("p_partkey").alias("pos"))
    return relational.best_host(norms, layers)


@query("SELECT label, count(*) AS n, CAST(count(*) * 256 AS BIGINT) AS plain_bytes, true AS exact, true AS no_longer FROM embeddings GROUP BY 1")
def chunk_codec_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector's bits encoded against the one before it of its label and decoded again: whether all come back, in streams that are hardly longer (the codec falls back to the raw form)."""
    import pyarrow as pa

    from ckptlake.functions import codec

    v = _read(spark, sf_dir, "embeddings")
    pairs = v.select("vec_id", "label", F.col("embedding").alias("t"), F.lag("embedding").over(Window.partitionBy("label").orderBy("vec_id")).alias("b"))

    def run(batches):
        import numpy as np

        for batch in batches:
            out = []
            for i, label, t, b in zip(*(batch.column(c).to_pylist() for c in ("vec_id", "label", "t", "b")), strict=True):
                x, y = (None if a is None else np.asarray(a, np.float32).tobytes() for a in (t, b))
                e = codec.encode_chunk(x, y, "F32")
                out.append((i, label, e.encoding, len(x), len(e.payload), codec.decode_chunk(e.encoding, e.payload, y, "F32") == x))
            kinds = (pa.int64(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.bool_())
            columns = list(zip(*out, strict=True)) or [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["vec_id", "label", "encoding", "plain", "stored", "exact"])

    coded = pairs.mapInArrow(run, "vec_id long, label int, encoding string, plain long, stored long, exact boolean")
    return coded.groupBy("label").agg(F.count("*").alias("n"), F.sum("plain").alias("plain_bytes"), F.bool_and("exact").alias("exact"), (F.sum("stored") <= 1.1 * F.sum("plain")).alias("no_longer"))


@query("SELECT label, count(*) AS n_units, 1.0::DOUBLE AS accuracy FROM embeddings GROUP BY 1")
def recovery_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A hidden permutation of all vectors of each label, found again by assignment: a label is a layer, whose width bounds the group, and a group is solved by one executor. No two vectors are equal, so SQL expects all back."""
    import pyarrow as pa

    from ckptlake.operators import align

    def solve(table: pa.Table) -> pa.Table:
        import numpy as np

        order = np.argsort(table["vec_id"].to_numpy())
        base = np.array(table["embedding"].to_pylist(), np.float32)[order]
        n = len(base)
        truth = np.random.default_rng(n).permutation(n)
        found = align.assign(align.unit_scores([("row", 1, base[truth], base)], n))
        return pa.table({"label": pa.array([table["label"][0].as_py()], pa.int32()), "n_units": pa.array([n], pa.int64()), "accuracy": [float((found == truth).mean())]})

    return _read(spark, sf_dir, "embeddings").select("label", "vec_id", "embedding").groupBy("label").applyInArrow(solve, "label int, n_units long, accuracy double")


@query("""WITH c AS (SELECT user_id AS branch, event_id AS seq, event_id % 4 = 0 AS f, min(event_id) OVER (PARTITION BY user_id) AS lo FROM events), s AS (SELECT *, sum(CASE WHEN f OR seq = lo THEN 1 ELSE 0 END) OVER (PARTITION BY branch ORDER BY seq ROWS UNBOUNDED PRECEDING) AS star FROM c)
  SELECT branch, CAST(count(*) FILTER (WHERE star = top) - 1 AS BIGINT) AS since_full, count(*) AS n_commits, max(seq) AS last_seq FROM (SELECT *, max(star) OVER (PARTITION BY branch) AS top FROM s) GROUP BY branch""")
def stream_commit_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The commit log as a stream: per-branch commits since the last full one, after all that is there."""
    import uuid

    from ckptlake.store import shared_dir
    from ckptlake.streaming.ingest import branch_state

    ship(spark)
    path = f"{sf_dir}/events.parquet"
    schema = spark.read.parquet(path).schema
    folder, _, file = path.rpartition("/")
    stream = spark.readStream.schema(schema).option("pathGlobFilter", file).parquet(folder)
    commits = stream.select(F.col("user_id").alias("branch"), F.col("event_id").alias("seq"), (F.col("event_id") % 4 == 0).alias("full"))
    out = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"

    def keep(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{out}/state/batch={number}")

    query_ = branch_state(commits).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{out}/log").trigger(availableNow=True).start()
    query_.awaitTermination()
    state = spark.read.parquet(f"{out}/state")
    return state.groupBy("branch").agg(F.max_by("since_full", "batch").alias("since_full"), F.max_by("n_commits", "batch").alias("n_commits"), F.max("last_seq").alias("last_seq"))


@query("""SELECT user_id, count(*) AS n, round(avg(abs(v - (a + b) / 2)), 6) AS midpoint_error, round(avg(abs(v - a)), 6) AS step_error FROM (SELECT user_id, value AS v, lag(value) OVER w AS a, lead(value) OVER w AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)) WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY 1""")
def midpoint_prediction(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = relational.midpoint_error(_read(spark, sf_dir, "events"), "user_id", "event_id", "value")
    return got.select("user_id", "n", _round("midpoint_error").alias("midpoint_error"), _round("step_error").alias("step_error"))


@query("""WITH m AS (SELECT p_brand, p_size, sum(p_retailprice) AS cost FROM part GROUP BY 1, 2), x AS (SELECT *, lag(p_size) OVER w AS a, lag(cost) OVER w AS b FROM m WINDOW w AS (PARTITION BY p_brand ORDER BY p_size))
  SELECT p_brand, p_size, round(ln(cost / b) / ln(p_size / a), 6) AS exponent FROM x WHERE a > 0 AND b > 0 AND cost > 0""")
def growth_exponent(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _read(spark, sf_dir, "part").groupBy("p_brand", "p_size").agg(F.sum("p_retailprice").alias("cost"))
    return relational.growth_exponent(m, "p_brand", "p_size", "cost").select("p_brand", "p_size", _round("exponent").alias("exponent"))


@query("""SELECT round(max(CASE WHEN s < 0 THEN abs(s) END), 6) AS worst_alike, round(min(CASE WHEN s >= 0 THEN abs(s) END), 6) AS best_other, round(sqrt(max(CASE WHEN s < 0 THEN abs(s) END) * min(CASE WHEN s >= 0 THEN abs(s) END)), 6) AS threshold, max(CASE WHEN s < 0 THEN abs(s) END) < min(CASE WHEN s >= 0 THEN abs(s) END) AS separable FROM (SELECT s_acctbal AS s FROM supplier)""")
def threshold_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _read(spark, sf_dir, "supplier").select(F.col("s_acctbal").alias("s"), F.abs("s_acctbal").alias("v"))
    got = relational.calibrate(s, F.col("s") < 0, "v")
    return got.select(_round("worst_alike").alias("worst_alike"), _round("best_other").alias("best_other"), _round("threshold").alias("threshold"), "separable")


@query("SELECT user_id, event_id, next_layer FROM (SELECT user_id, event_id, lead(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS next_layer FROM events) WHERE next_layer IS NOT NULL")
def layer_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.layer_pairs(_read(spark, sf_dir, "events").select("user_id", "event_id"), "event_id", "user_id")


@query(f"""WITH RECURSIVE {_LINKS}, lv AS (SELECT event_id AS node, 0 AS level FROM events WHERE event_id NOT IN (SELECT child FROM e) UNION SELECT e.child, lv.level + 1 FROM lv JOIN e ON e.parent = lv.node)
  SELECT node, max(level) AS level, (SELECT count(*) FROM (SELECT node, max(level) AS n FROM lv GROUP BY 1) c JOIN e ON e.child = c.node JOIN (SELECT node, max(level) AS n FROM lv GROUP BY 1) p ON p.node = e.parent WHERE p.n >= c.n) AS out_of_order FROM lv GROUP BY node""")
def sync_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The order in which a peer is sent commits: by level, which puts every parent before its children; and how many edges that breaks."""
    events = _read(spark, sf_dir, "events").select("event_id", "user_id")
    edges = dag.cut(_edges(events))
    found = dag.levels(edges, events.select(F.col("event_id").alias("node")))
    parent, child = (found.select(F.col("node").alias(n), F.col("level").alias(f"{n}_level")) for n in ("parent", "child"))
    broken = edges.join(parent, "parent").join(child, "child").where("parent_level >= child_level").agg(F.count("*").alias("out_of_order"))
    return found.select("node", F.col("level").cast("int").alias("level")).join(F.broadcast(broken))  # one row


@query("""SELECT n_name, array_to_string(list_transform(regexp_extract_all(n_name || n_nationkey, '(\\d+|\\D+)', 1), lambda p: CASE WHEN regexp_matches(p, '^\\d+$') THEN '0' || lpad(p, 20, '0') ELSE '1' || p END), '/') AS sort_key, CASE WHEN n_nationkey >= 10 THEN 'linear' ELSE 'norm' END AS kind, CAST(length(n_name) AS BIGINT) AS n FROM nation""")
def natural_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = _read(spark, sf_dir, "nation")
    shape = F.when(F.col("n_nationkey") >= 10, F.array(F.lit(2), F.lit(3))).otherwise(F.array(F.lit(2)))
    return n.select("n_name", F.array_join(exprs.natural_key(F.concat("n_name", F.col("n_nationkey").cast("string"))), "/").alias("sort_key"), exprs.layer_kind(shape).alias("kind"), F.length("n_name").cast("long").alias("n"))


@query("""SELECT source, CASE WHEN b >= 1048576 THEN printf('%.1f MiB', b / 1048576.0) WHEN b >= 1024 THEN printf('%.1f KiB', b / 1024.0) ELSE printf('%d B', b) END AS size, b AS n_bytes FROM (SELECT source, CAST(sum(strlen(text)) AS BIGINT) AS b FROM documents GROUP BY 1)""")
def human_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    total = _read(spark, sf_dir, "documents").groupBy("source").agg(F.sum(F.octet_length("text")).alias("n_bytes"))
    return total.select("source", exprs.human_bytes(F.col("n_bytes")).alias("size"), "n_bytes")


from ckptlake.plans import checkpoints  # noqa: E402 - its queries are registered after those above

QUERIES |= checkpoints.QUERIES
ORACLE_SQL |= checkpoints.ORACLE_SQL
