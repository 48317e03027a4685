"""The engine's relational operators, over any table.

Joins, aggregates and windows that the checkpoint path is made of; the entry
point's queries call these same functions over the driver's tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ckptlake.functions import exprs


def content_dedup(objects: DataFrame, content: Column, order: Column) -> DataFrame:
    """(object, n_refs, first_ref): each distinct content, and where it occurs first. One aggregate with partial sums."""
    return objects.groupBy(F.sha2(content, 256).alias("object")).agg(F.count("*").alias("n_refs"), F.min(order).alias("first_ref"))


def absent(candidates: DataFrame, present: DataFrame, key: str = "object") -> DataFrame:
    """Candidates whose key isn't present, once each: what a content-addressed put writes, and what a peer wants."""
    return candidates.dropDuplicates([key]).join(present.select(key), key, "left_anti")


def compare_sources(left: DataFrame, right: DataFrame, key: str, value: str) -> DataFrame:
    """Full outer comparison by key: equal, mismatched, missing_left or missing_right, and the difference."""
    a = left.select(key, F.col(value).alias("l"), F.lit(True).alias("in_left"))
    b = right.select(key, F.col(value).alias("r"), F.lit(True).alias("in_right"))
    status = F.when(F.col("in_left").isNull(), "missing_left").when(F.col("in_right").isNull(), "missing_right").when(F.col("l").eqNullSafe(F.col("r")), "equal").otherwise("mismatched")
    return a.join(b, key, "full_outer").select(key, "l", "r", status.alias("status"), F.abs(F.col("l") - F.col("r")).alias("diff"))


def merge_plan(ours: DataFrame, theirs: DataFrame, base: DataFrame, key: str, content: str) -> DataFrame:
    """What a three-way merge does with each key. A key that one side lacks is the other's, whatever the base has."""
    o, t, b = (df.select(key, F.col(content).alias(n)) for df, n in ((ours, "o"), (theirs, "t"), (base, "b")))
    joined = o.join(t, key, "full_outer").join(b, key, "left")
    action = (
        F.when(F.col("o").isNull(), "only-theirs")
        .when(F.col("t").isNull(), "only-ours")
        .when(F.col("o") == F.col("t"), "unchanged")
        .when(F.col("o").eqNullSafe(F.col("b")), "take-theirs")
        .when(F.col("t").eqNullSafe(F.col("b")), "take-ours")
        .otherwise("averaged")
    )
    return joined.select(key, "o", "t", "b", action.alias("action"))


def tiling_violations(segments: DataFrame, by: str | None, begin: str, end: str) -> DataFrame:
    """Segments that don't begin where the one before them ends."""
    w = (Window.partitionBy(by) if by else Window.partitionBy(F.lit(0))).orderBy(begin, end)
    return segments.withColumn("expected", F.lag(end, 1, 0).over(w)).where(F.col("expected") != F.col(begin))


def chunk_hash(rows: DataFrame, by: list[str], text: Column, order: str) -> DataFrame:
    """Digest of each chunk's rows in their order."""
    return rows.groupBy(*by).agg(F.count("*").alias("n_rows"), F.min(order).alias("row_start"), F.max(order).alias("row_end"), F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("k"), text.alias("v")))), lambda x: x["v"]), "|"), 256).alias("content_hash"))


def checkpoint_sizes(refs: DataFrame, by: str, obj: str, size: str) -> DataFrame:
    """References and their bytes, and distinct objects and theirs. An object of several references counts once a group."""
    once = refs.groupBy(by, obj).agg(F.count("*").alias("n"), F.sum(size).alias("all_bytes"), F.min(size).alias("one"))
    return once.groupBy(by).agg(F.sum("n").alias("n_refs"), F.sum("all_bytes").alias("original_bytes"), F.count("*").alias("n_objects"), F.sum("one").alias("stored_bytes"))


def residual_norms(pairs: DataFrame, by: str, target: str, base: str) -> DataFrame:
    """|target - base| / |target| of each group of vectors. Infinite where a vector isn't finite or lengths differ; 0 of 0 is 0."""
    bad = F.size(target) != F.size(base)
    elements = pairs.select(by, bad.alias("bad"), F.explode(F.arrays_zip(F.col(target).alias("t"), F.col(base).alias("b"))).alias("x"))
    t, b = F.col("x.t").cast("double"), F.col("x.b").cast("double")
    sums = elements.groupBy(by).agg(F.sqrt(F.sum((t - b) * (t - b))).alias("d"), F.sqrt(F.sum(t * t)).alias("n"), F.max("bad").alias("bad"))
    ratio = F.when(F.col("bad") | F.isnan("d") | F.isnan("n") | (F.col("n") == float("inf")), float("inf")).when(F.col("n") == 0, F.when(F.col("d") == 0, 0.0).otherwise(float("inf"))).otherwise(F.try_divide("d", "n"))
    return sums.select(by, ratio.alias("residual"))


def entropy(values: DataFrame, by: list[str], value: str) -> DataFrame:
    """Order-0 entropy in bits of each group's values: a histogram, then a sum."""
    counts = values.groupBy(*by, value).agg(F.count("*").alias("n"))
    totals = counts.groupBy(*by).agg(F.sum("n").alias("total"), F.sum(F.col("n") * F.log2(F.col("n").cast("double"))).alias("s"))
    return totals.select(*by, "total", (F.log2(F.col("total").cast("double")) - F.col("s") / F.col("total")).alias("entropy"))


def conditional_entropy(values: DataFrame, by: str, order: str, value: str) -> DataFrame:
    """Bits of a value given the one before it in its sequence, over all sequences."""
    before = F.lag(value).over(Window.partitionBy(by).orderBy(order))
    pairs = values.select(before.alias("a"), F.col(value).alias("b")).where("a is not null").groupBy("a", "b").agg(F.count("*").alias("n"))
    given = pairs.groupBy("a").agg(F.sum("n").alias("m"))
    joined = pairs.join(given, "a")
    return joined.agg(F.sum("n").alias("n_pairs"), (F.sum(F.col("n") * F.log2(F.col("m") / F.col("n"))) / F.sum("n")).alias("entropy"))


def sign_runs(values: DataFrame, by: str, order: str, value: str) -> DataFrame:
    """Runs of steps of one sign in each sequence: their number, mean length, and share of 8 or more."""
    w = Window.partitionBy(by).orderBy(order)
    steps = values.select(by, order, F.signum(F.col(value) - F.lag(value).over(w)).alias("sign")).where("sign is not null")
    marked = steps.withColumn("new", F.coalesce((F.col("sign") != F.lag("sign").over(w)).cast("int"), F.lit(1)))
    runs = marked.withColumn("run", F.sum("new").over(w)).groupBy(by, "run").agg(F.count("*").alias("n"))
    return runs.groupBy(by).agg(F.count("*").alias("n_runs"), F.avg("n").alias("mean_length"), F.avg((F.col("n") >= 8).cast("double")).alias("long_share"))


def star_anchors(history: DataFrame, by: str, order: str, full: Column) -> DataFrame:
    """For each commit of a linear history: the last full one at or before it, and the commits since."""
    w = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    marked = history.withColumn("full", full)
    grouped = marked.withColumn("star", F.sum(F.col("full").cast("long")).over(w))
    n = F.row_number().over(Window.partitionBy(by, "star").orderBy(order)) - 1
    return grouped.withColumn("since_full", n.cast("long")).withColumn("anchor", F.last(F.when(F.col("full"), F.col(order)), True).over(w))


def interval_gather(indices: DataFrame, index: str, chunks: DataFrame, rows_per_chunk: int | None = None) -> DataFrame:
    """Each index beside the chunk (row_start..row_end) that holds it; with chunks of one size the range join is an equi-join on the chunk's number."""
    if rows_per_chunk:
        return indices.withColumn("chunk_no", F.floor(F.col(index) / rows_per_chunk).cast("long")).join(chunks, "chunk_no")
    return indices.join(chunks, F.col(index).between(F.col("row_start"), F.col("row_end")))


def permuted_gather(rows: DataFrame, row: str, perm: DataFrame, keep: list[str]) -> DataFrame:
    """Row perm[i] of the base for each target row i; perm: (target_idx, base_idx)."""
    return perm.join(rows.withColumnRenamed(row, "base_idx"), "base_idx").select("target_idx", "base_idx", *keep)


def permutation_problems(perm: DataFrame, n: int) -> DataFrame:
    """Rows that keep (idx, val) from being a permutation of 0..n-1."""
    bad = perm.where((F.col("val") < 0) | (F.col("val") >= n)).select(F.lit("range").alias("problem"), F.col("val").alias("at"))
    twice = perm.groupBy("val").agg(F.count("*").alias("n")).where("n > 1").select(F.lit("repeated").alias("problem"), F.col("val").alias("at"))
    return bad.unionByName(twice)


def compose(first: DataFrame, second: DataFrame) -> DataFrame:
    """(idx, val) of taking first and then second: first[second[i]]."""
    return second.select("idx", F.col("val").alias("mid")).join(first.select(F.col("idx").alias("mid"), "val"), "mid").select("idx", "val")


def can_follow(layers: DataFrame) -> DataFrame:
    """Which layer's outputs another can take: its columns are a multiple of them. A join of a metadata table with itself."""
    a, b = layers.select(F.col("name").alias("consumer"), "cols"), layers.select(F.col("name").alias("producer"), "out")
    return a.join(b, (F.col("consumer") != F.col("producer")) & (F.col("out") > 0) & (F.pmod("cols", "out") == 0)).select("consumer", "producer")


def best_host(norms: DataFrame, layers: DataFrame) -> DataFrame:
    """For each norm the layer of equal width with the longest common dotted prefix, then the equal last index, then the nearest before it, then after."""
    joined = norms.alias("n").join(layers.alias("l"), F.col("n.width") == F.col("l.width"))
    gap = F.col("n.pos") - F.col("l.pos")
    ranked = joined.select(
        F.col("n.name").alias("norm"), F.col("l.name").alias("host"), exprs.shared_prefix(F.col("n.name"), F.col("l.name")).alias("prefix"),
        F.coalesce(exprs.trailing_index(F.col("n.name")) == exprs.trailing_index(F.col("l.name")), F.lit(False)).cast("int").alias("same_index"), (gap > 0).cast("int").alias("behind"), F.abs(gap).alias("gap"),
    )
    best = Window.partitionBy("norm").orderBy(F.desc("prefix"), F.desc("same_index"), F.desc("behind"), "gap", "host")
    return ranked.withColumn("place", F.row_number().over(best)).where("place = 1").select("norm", "host", "prefix")


def group_bit_delta(assessed: DataFrame, by: str, before: str, after: str, size: str, least_gain: float = 1e-6) -> DataFrame:
    """Gain in bits of each group, and whether it helped."""
    share = exprs.clipped_log_gain(F.col(before), F.col(after), F.col(size))
    out = assessed.groupBy(by).agg(F.coalesce(F.sum(share), F.lit(0.0)).alias("bit_delta"), F.count(share).alias("usable"))
    return out.withColumn("helped", (F.col("usable") > 0) & (F.col("bit_delta") < -least_gain))


def merge_average(planned: DataFrame, ours: str, theirs: str, is_int: Column) -> DataFrame:
    """The merged value under a plan: averaged where both changed, but ours for whole numbers."""
    a = F.when(F.col("action").isin("only-theirs", "take-theirs"), F.col(theirs)).when(F.col("action") != "averaged", F.col(ours)).when(is_int, F.col(ours)).otherwise((F.col(ours) + F.col(theirs)) / 2)
    return planned.withColumn("merged", a)


def verify_objects(referenced: DataFrame, stored: DataFrame) -> DataFrame:
    """Failures of referenced (object, checksum) against stored (object, payload): missing, checksum-mismatch, or content-mismatch, the first that applies."""
    joined = referenced.join(stored.withColumn("there", F.lit(True)), "object", "left")
    kind = F.when(F.col("there").isNull(), "missing").when(F.substring(F.sha2("payload", 256), 1, 16) != F.col("checksum"), "checksum-mismatch").when(F.sha2("payload", 256) != F.col("object"), "content-mismatch")
    return joined.withColumn("kind", kind).where("kind is not null")


def layer_pairs(layers: DataFrame, order: str, by: str | None = None) -> DataFrame:
    """Each layer beside the next one: what a window of two layers sees."""
    w = (Window.partitionBy(by) if by else Window.partitionBy(F.lit(0))).orderBy(order)
    return layers.withColumn("next_layer", F.lead(order).over(w)).where("next_layer is not null")


def midpoint_error(series: DataFrame, by: str, order: str, value: str) -> DataFrame:
    """How far each value lies from the mean of its two neighbours, and from the one before, over each series."""
    w = Window.partitionBy(by).orderBy(order)
    near = series.select(by, F.col(value).alias("v"), F.lag(value).over(w).alias("a"), F.lead(value).over(w).alias("b")).where("a is not null and b is not null")
    return near.groupBy(by).agg(F.count("*").alias("n"), F.avg(F.abs(F.col("v") - (F.col("a") + F.col("b")) / 2)).alias("midpoint_error"), F.avg(F.abs(F.col("v") - F.col("a"))).alias("step_error"))


def growth_exponent(measured: DataFrame, by: str, size: str, cost: str) -> DataFrame:
    """The power of its size by which a cost grew since the size before."""
    w = Window.partitionBy(by).orderBy(size)
    a, b = F.lag(size).over(w), F.lag(cost).over(w)
    return measured.select(by, size, cost, F.when((a > 0) & (F.col(size) > a) & (b > 0) & (F.col(cost) > 0), F.log(F.col(cost) / b) / F.log(F.col(size) / a)).alias("exponent")).where("exponent is not null")


def calibrate(measured: DataFrame, alike: Column, value: str) -> DataFrame:
    """The greatest value of what is alike, the least of what isn't, and the threshold between them."""
    ends = measured.agg(F.max(F.when(alike, F.col(value))).alias("worst_alike"), F.min(F.when(~alike, F.col(value))).alias("best_other"))
    return ends.withColumn("threshold", F.sqrt(F.col("worst_alike") * F.col("best_other"))).withColumn("separable", F.col("worst_alike") < F.col("best_other"))


def first_failures(failures: DataFrame, most: int, order: list[str]) -> DataFrame:
    """At most so many failures, with a mark if there were more."""
    top = failures.orderBy(*order).limit(most + 1).withColumn("place", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order)))
    return top.withColumn("truncated", F.max((F.col("place") > most).cast("boolean")).over(Window.partitionBy(F.lit(0)))).where(F.col("place") <= most).drop("place")
