"""Building blocks that keep jobs whole on skewed and growing data."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

BROADCAST_ROWS = 1_000_000
BROADCAST_BYTES = 64 << 20
HEAVY = 64  # a key with more than this part of the facts is spread
SPREAD = 256  # over this many tasks if it holds all of them


def staging_root(spark: SparkSession) -> str:
    """Shared folder for intermediate tables: the cluster's checkpoint folder.

    Where the session names none, a local master gets a folder of its own; on a
    cluster that is an error, since executors do not share their disks.
    """
    context = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not root:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="pagemill-"))
        root = context.getCheckpointDir()
    return root.rstrip("/")


def stage(df: DataFrame, label: str, codec: str | None = None) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    Cuts the lineage, survives the loss of any executor, and gives the planner
    real sizes to choose joins by.  ``codec`` packs large texts tighter than the session does.
    """
    return _stored(df, _staging_path(df.sparkSession, label), codec)


def _staging_path(spark: SparkSession, label: str) -> str:
    return f"{staging_root(spark)}/pagemill-stage/{label}-{uuid.uuid4().hex}"


def _stored(df: DataFrame, path: str, codec: str | None) -> DataFrame:
    (df.write.option("compression", codec) if codec else df.write).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove_folder(spark: SparkSession, path: str) -> None:
    """Remove a folder wherever Spark can write one; a missing one is no error."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Within the block a job's shuffle files go when it ends; else they wait until the driver's heap happens to fill.

    For writes: a frame that is asked again would miss its shuffles.
    """
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


@contextmanager
def staged(df: DataFrame, label: str, codec: str | None = None) -> Iterator[DataFrame]:
    """``stage`` for the length of a block, at whose end the table is removed: nothing that is read later may rest on it."""
    path = _staging_path(df.sparkSession, label)
    try:
        yield _stored(df, path, codec)
    finally:
        remove_folder(df.sparkSession, path)


def unused(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` bears it in any letter case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def compute_once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a costly column that later filters read instead of repeating.

    The optimizer pushes a filter on a projected column below the projection,
    with the whole expression copied into it.  It cannot push one below a
    generator, so the value is emitted by a generator of one element.
    """
    return df.select(*[c for c in df.columns if c != name], F.explode(F.array(value)).alias(name))


def measured_small(df: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> bool:
    """True when a count over the whole of ``df`` proves it small enough to broadcast."""
    size = F.octet_length(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])))
    rows, width = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(size), F.lit(0))).first()
    return rows <= max_rows and width <= max_bytes


def unsized(df: DataFrame) -> DataFrame:
    """``df`` as a side of a join that no estimate makes a broadcast.

    The planner sizes what is not stored yet by its row's width: to it a row that an explode
    repeats 33 times is still one row.  The other side is not broadcast either; skewed keys are still split.
    """
    return df.hint("merge")


def _scatter(df: DataFrame, on: Sequence[str]) -> Column:
    """Deterministic spread of rows over salts, from the columns that are not join keys."""
    plain = [
        f.name
        for f in df.schema.fields
        if f.name not in on and not isinstance(f.dataType, (T.MapType, T.VariantType))
    ]
    return F.xxhash64(*[F.col(f"`{c}`") for c in plain]) if plain else F.xxhash64(F.lit(0))


def heavy_keys(facts: DataFrame, on: Sequence[str]) -> dict[str, int]:
    """Keys that hold more than a HEAVY-th of the facts, as JSON, with the number of salts that spread them.

    A sketch of bounded size over one pass of the key columns; salts are in
    proportion to a key's share.  Nulls count as keys: an outer join keeps them.
    """
    top = F.call_function("approx_top_k", "key", F.lit(4 * HEAVY))
    n, found = facts.select(_key_text(on).alias("key")).agg(F.count(F.lit(1)), top).first()
    return {row["item"]: max(2, -(-row["count"] * SPREAD // n)) for row in found or [] if row["count"] * HEAVY > n}


def _key_text(on: Sequence[str], kinds: Sequence[T.DataType] | None = None) -> Column:
    columns = [F.col(f"`{c}`") if kinds is None else F.col(f"`{c}`").try_cast(kind) for c, kind in zip(on, kinds or on)]
    return F.to_json(F.struct(*[c.alias(f"k{i}") for i, c in enumerate(columns)]))


def join_dimension(
    facts: DataFrame,
    dim: DataFrame,
    on: Sequence[str],
    how: str = "inner",
    *,
    max_rows: int = BROADCAST_ROWS,
    max_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """Join a large, possibly skewed side with a side that is usually small.

    A dimension measured small is broadcast.  Beyond the bound the facts of
    heavy keys, found by a sketch, are salted in proportion to their number, and
    only the dimension's rows of those keys are repeated, once per salt.  ``how`` may be inner,
    left, left_semi or left_anti, for which salting changes no result.
    """
    on = list(on)
    if facts.isStreaming or dim.isStreaming:
        return facts.join(dim, on, how)
    if measured_small(dim, max_rows, max_bytes):
        return facts.join(F.broadcast(dim), on, how)
    heavy = heavy_keys(facts, on)
    if not heavy:
        return facts.join(dim, on, how)
    salt = unused(facts, unused(dim, "_salt"))
    table = F.create_map(*[F.lit(x) for item in heavy.items() for x in item])
    spread = F.pmod(_scatter(facts, on), F.try_element_at(table, _key_text(on)))
    salted = facts.withColumn(salt, F.coalesce(spread, F.lit(0)).cast("int"))
    copies = F.coalesce(F.try_element_at(table, _key_text(on, [facts.schema[c].dataType for c in on])), F.lit(1))
    repeated = dim.withColumn(salt, F.explode(F.sequence(F.lit(0), (copies - 1).cast("int"))))
    return salted.join(repeated, [*on, salt], how).drop(salt)


def number_rows(df: DataFrame, group: Sequence[str], order: Sequence[str], out: str) -> DataFrame:
    """Number rows from 1 within each group, without gathering a group in one task.

    Rows are range-partitioned and sorted, so a group of any size spans many
    partitions.  A row's number is its place in its partition plus the rows of
    its group in earlier partitions; only those per-partition counts meet in a
    window.  ``group`` and ``order`` together must identify a row.
    """
    keys = [*group, *order]
    placed = stage(
        df.repartitionByRange(*[F.col(k) for k in keys])
        .sortWithinPartitions(*keys)
        .withColumn("_row", F.monotonically_increasing_id())
        .withColumn("_part", F.shiftright("_row", 33).cast("int"))
        .withColumn("_row", F.col("_row").bitwiseAND(F.lit((1 << 33) - 1))),
        f"order-{out}",
    )
    counts = placed.groupBy(*group, "_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_row").alias("_first"))
    earlier = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(
        *group, "_part", (F.coalesce(F.sum("_n").over(earlier), F.lit(0)) - F.col("_first")).alias("_shift")
    )
    return (
        placed.join(starts, [*group, "_part"])
        .withColumn(out, F.col("_shift") + F.col("_row") + 1)
        .select(*df.columns, out)
    )


def dedupe_last(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Exactly one row per key, the last in ``order``; of rows equal in it, the one with the largest content hash.

    Winners are chosen first, on keys, order and hashes alone: copies of a hot
    key collapse in the map tasks.  Only keys that repeat are told to the second
    pass over ``df``, in which rows of other keys go through as they are.  Null
    keys are one key.
    """
    names = {c: unused(df, f"_{c}") for c in ("key", "hash", "last")}
    plain = [f.name for f in df.schema.fields if not isinstance(f.dataType, (T.MapType, T.VariantType))]
    key, place = F.struct(*[F.col(f"`{c}`") for c in keys]), F.struct(*[F.col(f"`{c}`") for c in order], names["hash"])
    marked = df.withColumns({names["hash"]: F.xxhash64(*[F.col(f"`{c}`") for c in plain]), names["key"]: key})
    winners = marked.groupBy(names["key"]).agg(F.count(F.lit(1)).alias("n"), F.max(place).alias(names["last"]))
    winners = stage(winners.filter("n > 1").drop("n"), "repeated")
    judged = join_dimension(marked, winners, [names["key"]], "left")
    rest = judged.filter(F.col(names["last"]).isNull())
    last = judged.filter(F.col(names["last"]) == place).dropDuplicates([names["key"]])  # rows equal in all columns
    columns = [f"`{c}`" for c in df.columns]
    return rest.select(*columns).unionByName(last.select(*columns))


keep_last = dedupe_last


def top_per_key(df: DataFrame, key: Sequence[str], order: Sequence[str], k: int, out: str = "rank") -> DataFrame:
    """Rank rows within a key and keep the first ``k``; trimmed before the shuffle."""
    w = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn(out, F.row_number().over(w)).filter(F.col(out) <= k)
