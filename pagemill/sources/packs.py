"""Knowledge packs: vectors, raw chunks and metadata per target and version."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagemill.functions import hashing
from pagemill.operators.scale import dedupe_last, join_dimension, keep_last, stage
from pagemill.sources import manifest
from pagemill.sources.cache import write_by_target
from pagemill.sources.targets import check_name

VECTOR_COLUMNS = ["target", "chunk_id", "embedding", "document", "source_url"]
CHUNK_COLUMNS = ["target", "chunk_id", "chunk_idx", "text", "source_url", "header"]
_ORDER = ["doc_ord", "chunk_idx"]
_MAX_LISTED = 1000
TABLES = ("vectors", "chunks", "metadata")
PART_ROWS = 50_000  # rows of a table that are written again together
_COMMIT = "target string, version string, table string, part int, parts int, publication string, run string, at long, commit string"


class PackNotFound(LookupError):
    """No published pack for the target."""


def last_chunks(chunks: DataFrame) -> DataFrame:
    """One row per chunk id of a staged chunk table; the last document to produce an id wins."""
    return keep_last(chunks, ["target", "chunk_id"], _ORDER)


def chunk_store(chunks: DataFrame) -> DataFrame:
    """Raw chunks of a table whose ids are unique already."""
    return chunks.select(*CHUNK_COLUMNS)


def write_chunks(chunks: DataFrame, path: str, json: bool = False) -> None:
    """Write the chunk store by target, as Parquet or as JSON lines for exchange."""
    keys = ["target", "chunk_id"]
    store = chunk_store(dedupe_last(chunks, keys, _ORDER)) if "doc_ord" in chunks.columns else chunks
    if json:
        store.hint("rebalance", "target").write.mode("overwrite").partitionBy("target").json(path)
    else:
        write_by_target(store, path)


def pack_metadata(docs: DataFrame, embedded: DataFrame, model: str, version: str | None = None) -> DataFrame:
    """One row per target: all documents, and embedded chunks before ids are made unique."""
    scraped = docs.groupBy("target").agg(F.count(F.lit(1)).alias("documents_scraped"))
    chunks = embedded.groupBy("target").agg(F.count(F.lit(1)).alias("chunks_embedded"))
    stamp = hashing.version_stamp() if version is None else F.lit(version)
    return scraped.join(chunks, "target", "left").select(
        F.col("target").alias("framework"),
        stamp.alias("version"),
        "documents_scraped",
        F.coalesce("chunks_embedded", F.lit(0)).cast("long").alias("chunks_embedded"),
        F.lit(model).alias("embedding_model"),
    )


def write_pack_metadata(metadata: DataFrame, path: str) -> None:
    metadata.write.mode("overwrite").json(path)


def upsert_vectors(existing: DataFrame, new: DataFrame, prune: bool = False) -> DataFrame:
    """Insert new ids and replace equal ones.

    ``new`` may repeat an id; with ``doc_ord``/``chunk_idx`` the last wins.  By
    default ids no longer produced stay; ``prune`` drops them for the targets
    in ``new``.  The result must be written to another path than ``existing``.
    """
    keys = ["target", "chunk_id"]
    if set(_ORDER) <= set(new.columns):
        new = dedupe_last(new, keys, _ORDER)
    new = new.select(*existing.columns)
    if prune:
        kept = join_dimension(existing, new.select("target").distinct(), ["target"], "left_anti")
    else:
        kept = existing.join(new.select(*keys), keys, "left_anti")
    return kept.unionByName(new)


def _version_key(version: Column) -> Column:
    """Versions in order: part by part, numbers by value, so that 2024.10 comes after 2024.9."""
    return F.transform(F.split(version, r"\."), lambda x: F.struct(F.length(F.regexp_replace(x, r"^0+(?=\d)", "")), F.regexp_replace(x, r"^0+(?=\d)", "")))


def commits(spark: SparkSession, root: str) -> DataFrame:
    """What was published: one row per target, version, table and part, naming the publication that holds its rows.

    A pack is the rows that its version's last commit names, whatever else lies in the folders.
    """
    last = Window.partitionBy("target", "version").orderBy(F.desc("at"), F.desc("commit"))
    ranked = manifest.read(spark, f"{root}/commits", _COMMIT).withColumn("place", F.dense_rank().over(last))
    return ranked.filter("place = 1").drop("place")


def latest(spark: SparkSession, root: str) -> DataFrame:
    """The rows of ``commits`` of each target's latest version."""
    every = stage(commits(spark, root), "commits")
    newest = every.groupBy("target").agg(F.max(F.struct(_version_key(F.col("version")), "version")).alias("v"))
    return every.join(newest.select("target", F.col("v.version").alias("version")), ["target", "version"])


def _made(tables: dict[str, DataFrame], name: str) -> DataFrame:
    """The rows of a table, made once: they are counted before they are dealt over parts."""
    return stage(tables[name], f"new-{name}")


def _placed(table: DataFrame, parts: DataFrame) -> DataFrame:
    """Rows with their part: chunk ids dealt over as many parts as the target has."""
    rows = join_dimension(table.drop("version"), parts.select("target", "parts"), ["target"])
    return rows.withColumn("part", F.pmod(F.xxhash64("chunk_id"), F.col("parts")).cast("int")).drop("parts")


def _parts_of(table: DataFrame) -> DataFrame:
    """(target, parts): as many as hold PART_ROWS rows each."""
    counts = table.groupBy("target").agg(F.count(F.lit(1)).alias("n"))
    return stage(counts.select("target", F.ceil(F.col("n") / PART_ROWS).cast("int").alias("parts")), "pack-parts")


def _write(rows: DataFrame, root: str, name: str, publication: str) -> DataFrame:
    """Write (target, part, ...) rows under a publication of their own; the (target, part) pairs written."""
    rows.withColumn("publication", F.lit(publication)).hint("rebalance", "target", "part").write.mode("append").partitionBy(
        "target", "part", "publication"
    ).parquet(f"{root}/{name}")
    written = _table(rows.sparkSession, f"{root}/{name}").filter(F.col("publication") == publication)
    return written.select("target", "part").distinct()


def _commit(spark: SparkSession, entries: DataFrame, root: str, version: str, run: str | None) -> None:
    """Make a version's entries (target, table, part, parts, publication) the ones that readers see."""
    told = entries.select(
        "target", F.lit(version).alias("version"), "table", "part", "parts", "publication", F.lit(run).cast("string").alias("run"),
        F.unix_micros(F.current_timestamp()).alias("at"), F.lit(uuid.uuid4().hex).alias("commit"),
    )
    manifest.append(stage(told, "pack-entries"), f"{root}/commits")


def _checked(tables: dict[str, DataFrame]) -> None:
    missing = [t for t in TABLES if t not in tables]
    if missing:
        raise PackNotFound(f"no processed output for: {', '.join(missing)}")


def _written_metadata(tables: dict[str, DataFrame], root: str, publication: str) -> DataFrame:
    named = tables["metadata"].withColumns({"target": F.col("framework"), "part": F.lit(0)}).drop("version")
    return _write(named, root, "metadata", publication).select("target", F.lit("metadata").alias("table"), "part", F.lit(1).alias("parts"), F.lit(publication).alias("publication"))


def publish_pack(tables: dict[str, DataFrame], root: str, version: str, run: str | None = None) -> None:
    """Publish ``vectors``, ``chunks`` and ``metadata`` of all targets as a version.

    Rows are written first, under a name of their own; the commit, one file,
    comes last.  Until then, and if this stops on the way, readers see what
    they saw before, in all three tables.  ``run`` names the run in the commit.
    """
    _checked(tables)
    spark = tables["metadata"].sparkSession
    publication = uuid.uuid4().hex
    entries = _written_metadata(tables, root, publication)
    for name in ("vectors", "chunks"):
        rows = _made(tables, name)
        parts = _parts_of(rows)
        written = _write(_placed(rows, parts), root, name, publication)
        entries = entries.unionByName(written.join(parts, "target").select(
            "target", F.lit(name).alias("table"), "part", "parts", F.lit(publication).alias("publication")))
    _commit(spark, entries, root, version, run)


def upsert_pack(tables: dict[str, DataFrame], root: str, version: str, prune: bool = False, run: str | None = None) -> None:
    """Publish a version that has the new rows in place of equal ids of each target's last one.

    Only parts that new ids fall into are read and written again; all others
    pass into the version by reference.  Ids no longer produced stay, unless
    ``prune``: then nothing old is read.  Targets without an earlier version are
    published as they are, targets without new rows in ``metadata`` not at all.
    """
    _checked(tables)
    spark = tables["metadata"].sparkSession
    publication = uuid.uuid4().hex
    entries = _written_metadata(tables, root, publication)
    built = stage(tables["metadata"].select(F.col("framework").alias("target")).distinct(), "built-targets")
    old = stage(latest(spark, root).join(built, "target", "left_semi"), "earlier-parts")
    for name in ("vectors", "chunks"):
        mine = old.filter(F.col("table") == name)
        known = mine.groupBy("target").agg(F.max("parts").alias("parts"))
        made = _made(tables, name)
        fresh = _parts_of(made)
        # a target keeps its number of parts, unless the new rows alone ask for several times as many
        parts = fresh.join(known.withColumnRenamed("parts", "before"), "target", "full")
        keeps = F.col("before").isNotNull() & (F.coalesce("parts", F.lit(0)) <= 4 * F.col("before"))
        parts = stage(parts.select("target", F.when(keeps, F.col("before")).otherwise(F.col("parts")).alias("parts"), (F.col("before").isNotNull() & ~keeps).alias("dealt_anew")), "pack-parts")
        new = _placed(made, parts)
        touched = new.select("target", "part").distinct()
        again = mine.join(parts.filter("dealt_anew").select("target"), "target", "left_semi")
        held = mine.join(parts.filter("dealt_anew").select("target"), "target", "left_anti")
        if prune:
            rows, kept = new, held.limit(0)
        else:
            met = stage(held.join(touched, ["target", "part"], "left_semi").unionByName(again).select("target", "part", "publication"), "touched-parts")
            before = _rows_of(_table(spark, f"{root}/{name}"), met) if not met.isEmpty() else None
            rows = new
            if before is not None:
                stays = before.drop("publication", "part").join(new.select("target", "chunk_id"), ["target", "chunk_id"], "left_anti")
                rows = new.unionByName(_placed(stays, parts).select(*new.columns))
            kept = held.join(touched, ["target", "part"], "left_anti")
        written = _write(rows, root, name, publication).join(parts, "target")
        entries = entries.unionByName(written.select("target", F.lit(name).alias("table"), "part", "parts", F.lit(publication).alias("publication")))
        entries = entries.unionByName(kept.select("target", "table", "part", "parts", "publication"))
    _commit(spark, entries, root, version, run)


def _rows_of(everything: DataFrame, places: DataFrame) -> DataFrame:
    """The rows of some (target, part, publication) folders; an ordinary number of them prunes the others."""
    keys = ["target", "part", "publication"]
    listed = places.select(*keys).distinct().limit(_MAX_LISTED + 1).collect()
    if len(listed) > _MAX_LISTED:
        return join_dimension(everything, places.select(*keys).distinct(), keys, "left_semi")
    names = sorted({p.target for p in listed})
    place = F.concat_ws("/", "publication", F.col("part").cast("string"), "target")
    return everything.filter(F.col("target").isin(names) & place.isin([f"{p.publication}/{p.part}/{p.target}" for p in listed]))


def _table(spark: SparkSession, path: str) -> DataFrame:
    """A stored table with its target as the text it was written as, not as a number or date."""
    found = spark.read.parquet(path).schema
    kinds = {"target": T.StringType(), "publication": T.StringType(), "part": T.IntegerType()}
    return spark.read.schema(T.StructType([T.StructField(f.name, kinds.get(f.name, f.dataType)) for f in found.fields])).parquet(path)


def load_pack(spark: SparkSession, root: str, target: str, version: str | None = None, table: str = "vectors") -> DataFrame:
    """A pack's table for one target, its latest version by default; only the folders of its commit are read."""
    check_name(target)
    own = commits(spark, root).filter(F.col("target") == target)
    if version is None:
        newest = own.agg(F.max(F.struct(_version_key(F.col("version")), "version")).alias("v")).first().v
        version = newest and newest[1]
    entries = own.filter((F.col("version") == version) & (F.col("table") == table)) if version else None
    if entries is None or entries.isEmpty():
        raise PackNotFound(target)
    rows = _rows_of(_table(spark, f"{root}/{table}"), entries)
    return rows.drop("part", "publication").withColumn("version", F.lit(version))


def load_packs(spark: SparkSession, root: str, table: str = "vectors") -> DataFrame:
    """A table of all packs, each target at its latest version."""
    entries = stage(latest(spark, root).filter(F.col("table") == table), "latest-packs")
    if entries.isEmpty():
        raise PackNotFound(root)
    rows = _rows_of(_table(spark, f"{root}/{table}"), entries)
    return join_dimension(rows.drop("part", "publication"), entries.select("target", "version").distinct(), ["target"])


def handled(spark: SparkSession, root: str, run: str) -> DataFrame:
    """Targets that a run of this name has published."""
    return commits(spark, root).filter(F.col("run") == run).select("target").distinct()


def write_graph(nodes: DataFrame, edges: DataFrame, path: str, node_pages: DataFrame | None = None) -> None:
    """Write nodes and edges by target, and the paged chunk lists of the nodes where given."""
    write_by_target(nodes, f"{path}/nodes")
    write_by_target(edges, f"{path}/edges")
    if node_pages is not None:
        write_by_target(node_pages, f"{path}/node_pages")
