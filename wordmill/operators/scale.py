"""Building blocks that keep the operators distributed: settled tables, global numbering, hot keys."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

SETTING = "spark.checkpoint.dir"
BROADCAST_BYTES = 64 * 1024 * 1024
#: A token is salted when it holds more than one of this many shares of a task's rows.
SHARES_PER_TASK = 8
_LOCAL_BITS = 33
_LOCAL_FOLDERS: dict[str, str] = {}


def checkpoint_folder(spark: SparkSession) -> str:
    """Shared folder named by the cluster; a temporary one only in local mode, the same for all of a session's tables."""
    folder = spark.conf.get(SETTING, None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"{SETTING} must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_FOLDERS:
        _LOCAL_FOLDERS[app] = tempfile.mkdtemp(prefix="wordmill-")
    return _LOCAL_FOLDERS[app]


def run_folder(spark: SparkSession) -> str:
    """Folder of all intermediate tables of this application."""
    return f"{checkpoint_folder(spark).rstrip('/')}/wordmill-{spark.sparkContext.applicationId}"


def new_path(spark: SparkSession, name: str = "table") -> str:
    return f"{run_folder(spark)}/{name}-{uuid.uuid4().hex}"


def clean_up(spark: SparkSession) -> bool:
    """Delete the intermediate tables of this application; results that were not written elsewhere go with them."""
    path = spark._jvm.org.apache.hadoop.fs.Path(run_folder(spark))
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def task_count(spark: SparkSession) -> int:
    """Tasks for compute-heavy work on a small table, which would otherwise be packed into a few."""
    return max(
        spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))
    )


def settle(df: DataFrame, name: str = "table") -> DataFrame:
    """Write a table to the shared folder and read it back.

    Cuts the lineage, survives lost executors, fixes partition-dependent values, and gives later plans
    the exact size of the table, so Spark's own broadcast threshold decides on facts.
    """
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def numbered(
    df: DataFrame,
    order: list[Column],
    by: list[str] | None = None,
    name: str = "rank",
    start: int = 1,
) -> DataFrame:
    """Consecutive numbers in a global (or per-group) order without a single-task window.

    A range-partitioned sort spreads even one huge group over all tasks and is written once. A row's
    number is its place among its group's rows in its sorted partition plus the group's rows in earlier
    partitions; the table of those offsets has at most (partitions + groups) rows.
    """
    by = by or []
    ordered = settle(
        df.orderBy(*by, *order).withColumn("_at", F.monotonically_increasing_id()), "sorted"
    ).withColumn("_part", F.shiftright("_at", _LOCAL_BITS))
    runs = ordered.groupBy("_part", *by).agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    earlier = W.partitionBy(*by).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    before = F.coalesce(F.sum("_n").over(earlier), F.lit(0))
    offsets = runs.select("_part", *by, (before - F.col("_first") + start).alias("_offset"))
    if by:
        offsets = settle(offsets, "offsets")
        same = [ordered["_part"] == offsets["_part"]] + [ordered[c].eqNullSafe(offsets[c]) for c in by]
        joined = ordered.join(offsets, same)
    else:
        joined = ordered.join(F.broadcast(offsets), "_part")
    return joined.select(*[ordered[c] for c in df.columns], (F.col("_at") + F.col("_offset")).alias(name))


def cumulated(df: DataFrame, order: list[Column], value: str, name: str = "before") -> DataFrame:
    """Sum of ``value`` over all earlier rows of a global order, without a single-task window."""
    ordered = settle(
        df.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()), "sorted"
    ).withColumn("_part", F.shiftright("_at", _LOCAL_BITS))
    parts = ordered.groupBy("_part").agg(F.sum(value).alias("_sum"))
    earlier = lambda by: by.rowsBetween(W.unboundedPreceding, -1)
    none = F.lit(0)
    offsets = parts.select("_part", F.coalesce(F.sum("_sum").over(earlier(W.orderBy("_part"))), none).alias("_offset"))
    inside = F.coalesce(F.sum(value).over(earlier(W.partitionBy("_part").orderBy("_at"))), none)
    placed = ordered.withColumn("_inside", inside).join(F.broadcast(offsets), "_part")
    return placed.select(*df.columns, (F.col("_inside") + F.col("_offset")).alias(name))


def row_bytes(df: DataFrame) -> Column:
    """Upper estimate of the in-memory size of a row of strings and plain values: its strings plus 16 bytes per value."""
    strings = [F.coalesce(F.octet_length(f.name), F.lit(0)) for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    per_row = F.lit(16 * len(df.columns))
    for s in strings:
        per_row = per_row + s
    return per_row


def table_bytes(df: DataFrame) -> int:
    """Upper estimate of the in-memory size of a settled table."""
    return df.agg(F.coalesce(F.sum(row_bytes(df)), F.lit(0))).first()[0]


def is_small(df: DataFrame, limit: int = BROADCAST_BYTES) -> bool:
    return table_bytes(df) <= limit


def _common(table: DataFrame, limit: int) -> tuple[DataFrame, DataFrame] | None:
    """The words of a table with ``freq`` that are frequent enough for all of them to fit in ``limit`` bytes, and the others.

    Frequencies are cut where a quarter of a power of two begins, so a few hundred sums decide.
    """
    step = F.floor(F.log2(F.greatest(F.coalesce("freq", F.lit(0)), F.lit(0)) + 1) * 4)
    sums = table.groupBy(step.alias("step")).agg(F.sum(row_bytes(table)).alias("bytes")).orderBy(F.desc("step")).collect()
    least, held = None, 0
    for r in sums:
        held += r["bytes"]
        if held > limit:
            break
        least = r["step"]
    return None if least is None else (table.where(step >= least), table.where(step < least))


def _token_weights(rows: DataFrame, table: DataFrame, on: str) -> DataFrame:
    """How often a token comes: the table's column ``freq``, or else counts of the corpus tokens."""
    if "freq" in table.columns:
        return table.select(on, F.col("freq").alias("_n"))
    return settle(rows.where(F.col(on).isNotNull()).groupBy(on).agg(F.count("*").alias("_n")), "counts")


def _by_weight(table: DataFrame, weights: DataFrame, on: str) -> DataFrame:
    return table if "freq" in table.columns else settle(table.join(weights.withColumnRenamed("_n", "freq"), on, "left"), "weighed")


def _uncommon(rows: DataFrame, common: DataFrame, on: str) -> DataFrame:
    return rows.where(F.col(on).isNotNull()).join(F.broadcast(common.select(on)), on, "left_anti")


def join_by_token(rows: DataFrame, table: DataFrame, how: str = "inner", on: str = "token", once: bool = False) -> DataFrame:
    """Equi-join of corpus tokens with a settled vocabulary-sized table, one row per token.

    A table of measured small size is broadcast. Of a larger one the most frequent words are, as many as fit in that size:
    nearly all occurrences meet one of them where they are, and only the others, which are rare, are shuffled. The
    weights are the table's column ``freq``, or else counts of the corpus tokens. ``once`` is for rows that are costly to make:
    with a larger table they are written with what they met, a token only where it met nothing, and null otherwise.
    """
    if is_small(table):
        return rows.join(F.broadcast(table), on, how)
    weights = _token_weights(rows, table, on)
    parts = _common(_by_weight(table, weights, on), BROADCAST_BYTES)
    if parts is None:
        return _join_shuffled(rows, table, weights, how, on)
    common, rest = (part.select(*table.columns) for part in parts)
    known = F.broadcast(common.withColumn("_known", F.lit(True)))
    if once:
        met = rows.join(known, on, "left").withColumn(on, F.when(F.col("_known").isNull(), F.col(on)))
        met = settle(met, "met")
        near = met.where(F.col("_known").isNotNull() if how == "inner" else F.col("_known").isNotNull() | F.col(on).isNull())
        far = _join_shuffled(met.where(F.col("_known").isNull() & F.col(on).isNotNull()).select(*rows.columns), rest, weights, how, on)
        return near.select(*far.columns).unionByName(far)
    near = rows.join(known, on, how).where(F.col("_known").isNotNull() | F.col(on).isNull())
    far = _join_shuffled(_uncommon(rows, common, on), rest, weights, how, on)
    return near.select(*far.columns).unionByName(far)


def gather_by_token(
    rows: DataFrame, table: DataFrame, key: str, item: Column, others: list[Column] | None = None, on: str = "token"
) -> DataFrame:
    """Left join as in ``join_by_token``, and back to one row per key: ``(key, items, others)``, the items sorted.

    ``rows`` arrive partitioned by ``key``, and what meets a broadcast word stays there. Only the rare tokens of a large table
    travel, once to their words and once back to their key, which is never null; the rows are made once, and what they met is written
    with the tokens that met nothing.
    """
    others = others or []
    parts = weights = None
    if not is_small(table):
        weights = _token_weights(rows, table, on)
        parts = _common(_by_weight(table, weights, on), BROADCAST_BYTES)
    if parts is None:
        hits = join_by_token(rows, table, "left", on) if weights is None else _join_shuffled(rows, table, weights, "left", on)
        return hits.groupBy(key).agg(F.sort_array(F.collect_list(item)).alias("items"), *others)
    common, rest = (part.select(*table.columns) for part in parts)
    near = rows.join(F.broadcast(common.withColumn("_known", F.lit(True))), on, "left")
    met = F.col("_known").isNotNull() | F.col(on).isNull()
    rare = F.struct(*[c for c in rows.columns if c != key])
    near = near.groupBy(key).agg(F.collect_list(F.when(met, item)).alias("items"), F.collect_list(F.when(~met, rare)).alias("_rare"), *others)
    near = settle(near, "met")
    rows = near.select(key, F.explode("_rare").alias("_t")).select(key, "_t.*")
    far = _join_shuffled(rows, rest, weights, "left", on).groupBy(key).agg(F.collect_list(item).alias("_more"))
    none = F.array().cast(far.schema["_more"].dataType)
    both = near.drop("_rare").join(far, key, "left")
    return both.withColumn("items", F.sort_array(F.concat("items", F.coalesce("_more", none)))).drop("_more")


def _join_shuffled(rows: DataFrame, table: DataFrame, weights: DataFrame, how: str, on: str) -> DataFrame:
    """One shuffled join in which no task gets all occurrences of a common token.

    Tokens that hold more than a task's share
    are salted by their own share, so the list of them has at most as many rows as there are shares. Rows that differ in any
    column get salts of their own; null tokens, which match nothing, are spread too.
    """
    shares = SHARES_PER_TASK * task_count(rows.sparkSession)
    share = max(1, (weights.agg(F.sum("_n")).first()[0] or 0) // shares + 1)
    heavy = weights.where(F.col("_n") > share)
    hot = settle(heavy.select(on, F.ceil(F.col("_n") / share).cast("int").alias("_salts")), "hot")
    columns = [c for c in table.columns if c != on]
    parts = F.when(F.col(on).isNull(), F.lit(shares)).otherwise(F.coalesce("_salts", F.lit(1)))
    salted = rows.join(F.broadcast(hot), on, "left").withColumn("_salt", F.pmod(F.xxhash64(*rows.columns), parts))
    salts = F.sequence(F.lit(0).cast("bigint"), F.coalesce("_salts", F.lit(1)).cast("bigint") - 1)
    copies = table.join(F.broadcast(hot), on, "left").withColumn("_salt", F.explode(salts)).drop("_salts")
    return salted.join(copies, [on, "_salt"], how).select(*rows.columns, *columns)


def mark_first(
    df: DataFrame, order: Column, ties: list[str], n: Column | int, by: list[str] | None = None
) -> DataFrame:
    """Flag the rows that come first (exactly ``n``, per group) in the order of a uniform hex digest.

    Counting the first four digits of the digest finds the one bin in which the quota ends; the rows of
    lower bins are taken by a broadcast lookup, and only the rows of that bin (one in 65,536) are sorted.
    The wide rows themselves are neither sorted nor shuffled.
    """
    by = by or []
    keyed = df.withColumn("_digest", order).withColumn("_bin", F.substring("_digest", 1, 4))
    counts = settle(keyed.groupBy(*by, "_bin").agg(F.count("*").alias("_n")), "bins")
    before = W.partitionBy(*by).orderBy("_bin").rowsBetween(W.unboundedPreceding, -1)
    quota = n if isinstance(n, Column) else F.lit(n)
    left = quota - F.coalesce(F.sum("_n").over(before), F.lit(0))
    bins = settle(counts.select(*by, "_bin", "_n", left.alias("_left")), "bins")
    placed = keyed.join(bins, [*by, "_bin"])
    whole = (F.col("_left") >= F.col("_n")) | (F.col("_left") <= 0)
    clear = placed.where(whole).withColumn("taken", F.col("_left") > 0)
    order_cut = [F.col("_digest"), *[F.col(t) for t in ties]]
    cut = numbered(placed.where(~whole), order_cut, [*by, "_bin"], name="_place")
    cut = cut.withColumn("taken", F.col("_place") <= F.col("_left"))
    return clear.select(*df.columns, "taken").unionByName(cut.select(*df.columns, "taken"))


def take_first(
    df: DataFrame, order: Column, ties: list[str], n: Column | int, by: list[str] | None = None
) -> DataFrame:
    """Exactly the first ``n`` rows (per group) in the order of a uniform hex digest."""
    return mark_first(df, order, ties, n, by).where("taken").drop("taken")
