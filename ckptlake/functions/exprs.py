"""Scalar functions as columns: bit arithmetic of residuals, decisions, names, sizes.

All of them are built-in expressions, so they stay inside generated code and
below the optimizer's eyes. Arithmetic modulo 2**16 is written with masks, as
overflow is an error in ANSI mode.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MASK = 0xFFFF


def delta16(target: Column, base: Column) -> Column:
    return (target - base).bitwiseAND(MASK)


def add16(base: Column, delta: Column) -> Column:
    return (base + delta).bitwiseAND(MASK)


def zigzag16(delta: Column) -> Column:
    """Small steps of either sign become small numbers."""
    return (delta * 2).bitwiseAND(MASK).bitwiseXOR(F.when(delta >= 0x8000, MASK).otherwise(0))


def unzigzag16(z: Column) -> Column:
    return F.shiftright(z, 1).bitwiseXOR(F.when(z.bitwiseAND(1) == 1, MASK).otherwise(0))


def escapes(z: Column) -> Column:
    """Whether a zigzag value needs the wide plane."""
    return z >= 255


def rows_per_chunk(chunk_bytes: int, row_bytes: Column) -> Column:
    return F.greatest(F.lit(1).cast("long"), F.floor(F.lit(chunk_bytes) / F.greatest(row_bytes, F.lit(1))).cast("long"))


def overlaps(begin: Column, end: Column, other_begin: Column, other_end: Column) -> Column:
    """Half-open ranges that share something."""
    return (begin < other_end) & (other_begin < end)


def is_delta(encoding: Column) -> Column:
    return encoding.isin("delta-shuffle", "delta-zigzag-escape")


def anchor_decision(ratio: Column, depth: Column, worst_ratio: float = 0.9, deepest: int = 3) -> Column:
    """Whether a tensor starts a new chain: its residual saves too little, or its chain is long."""
    return F.when((ratio >= worst_ratio) | (depth >= deepest), "anchor").otherwise("delta")


def stored_in_full(anchor: Column, since_full: Column, interval: int = 4) -> Column:
    return anchor.isNull() | (since_full >= interval - 1)


def branch_name_ok(name: Column) -> Column:
    return (F.length(name) > 0) & ~name.startswith("-") & ~name.contains("/") & ~name.contains("\\") & ~name.contains("..")


def is_hex_hash(x: Column) -> Column:
    return x.rlike("^[0-9a-f]{64}$")


def layer_kind(shape: Column) -> Column:
    return F.when(F.size(shape) == 4, "conv").when(F.size(shape) == 2, "linear").when(F.size(shape) == 1, "norm").otherwise("other")


def stem(name: Column) -> Column:
    return F.when(name.contains("."), F.regexp_extract(name, r"^(.*)\.[^.]*$", 1)).otherwise("")


def suffix(name: Column) -> Column:
    return F.element_at(F.split(name, r"\."), -1)


def natural_key(name: Column) -> Column:
    """Sorts like the name with its numbers compared as numbers."""
    return F.transform(F.regexp_extract_all(name, F.lit(r"(\d+|\D+)"), F.lit(1)), lambda p: F.when(p.rlike(r"^\d+$"), F.concat(F.lit("0"), F.lpad(p, 20, "0"))).otherwise(F.concat(F.lit("1"), p)))


def shared_prefix(a: Column, b: Column) -> Column:
    """How many dotted parts two names have in common from the left."""
    same = F.zip_with(F.split(a, r"\."), F.split(b, r"\."), lambda x, y: F.coalesce(x == y, F.lit(False)))
    return F.aggregate(same, F.struct(F.lit(0).alias("n"), F.lit(True).alias("go")), lambda s, x: F.struct((s["n"] + F.when(s["go"] & x, 1).otherwise(0)).alias("n"), (s["go"] & x).alias("go")), lambda s: s["n"])


def trailing_index(name: Column) -> Column:
    digits = F.regexp_extract(name, r"(\d+)$", 1)
    return F.when(digits == "", None).otherwise(digits.cast("int"))


def human_bytes(n: Column) -> Column:
    """1-decimal sizes in powers of 1024."""
    out = F.format_string("%d B", n.cast("long"))
    for power, unit in enumerate(("KiB", "MiB", "GiB", "TiB"), 1):
        out = F.when(n >= 1024**power, F.format_string(f"%.1f {unit}", n / float(1024**power))).otherwise(out)
    return out


def clipped_log_gain(before: Column, after: Column, size: Column, limit: float = 8.0) -> Column:
    """A tensor's share of a group's gain in bits: its size times the logarithm of its residuals' ratio, bounded; null where that says nothing."""
    both = before.isNotNull() & after.isNotNull() & ~F.isnan(before) & ~F.isnan(after) & (before != float("inf")) & (after != float("inf"))
    return F.when(both & (before > 0) & (after > 0), size * F.greatest(F.lit(-limit), F.least(F.lit(limit), F.log(after / before)))).when(both & (before > 0) & (after == 0), size * -limit).when(both & (before == 0) & (after > 0), size * limit)


def col_permute(row: Column, perm: Column, block: int) -> Column:
    """Blocks of columns of a row, in the order of perm."""
    return F.flatten(F.transform(perm, lambda p: F.slice(row, p * block + 1, block)))


def canonical_json(fields: dict[str, Column]) -> Column:
    """JSON of the fields with sorted keys, without blanks, with nulls kept."""
    return F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)]), {"ignoreNullFields": "false"})
