"""Incremental builds: documents stream in, packs stay current."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pagemill.operators import chunking, encode
from pagemill.operators.scale import dedupe_last, join_dimension, remove_folder, shuffles_removed, stage, staged
from pagemill.plans.build import build_vectors
from pagemill.sources import manifest, packs
from pagemill.sources.cache import write_by_target
from pagemill.sources.pages import spread

TABLES = ("vectors", "chunks")
CODEC = "zstd"  # of the log and of what a batch stages: every text is stored in several forms
FILE_ROWS = 1000  # rows per task and target from which files are large enough without a shuffle
_RUN = "low long, high long"


def stream_documents(
    docs: DataFrame, path: str, checkpoint: str, encoder: encode.EncoderFactory, *, fanout: int | None = None, **trigger
) -> StreamingQuery:
    """Chunk, clean and encode a stream of documents into a log of vectors and chunks.

    Every micro-batch replaces its own folder and is recorded when both of its
    tables are written, so a repeated batch changes nothing and a half-written
    one is not read; the latest batch of an id wins on reading.  With ``fanout``
    the log is compacted after every batch.  What a batch stages goes when it is
    written, so a stream's disk is that of its log, which ``vacuum`` keeps to the live runs.
    """

    def append(batch: DataFrame, batch_id: int) -> None:
        with staged(chunking.retrieval_chunks(spread(batch)), "stream-chunks", CODEC) as made:
            chunks, balanced = packs.last_chunks(made), _balanced(made)
            for name, table in (("vectors", build_vectors(chunks, encoder)), ("chunks", packs.chunk_store(chunks))):
                _write(table, f"{path}/{name}", _name(batch_id, batch_id), balanced)
        _record(batch.sparkSession, path, batch_id, batch_id)
        if fanout:
            compact(batch.sparkSession, path, fanout)

    return (
        docs.writeStream.foreachBatch(append)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def _balanced(rows: DataFrame) -> bool:
    """True where the tasks that read a stored table hold FILE_ROWS rows of each target, on an average."""
    n, targets = rows.agg(F.count(F.lit(1)), F.count_distinct("target")).first()
    return n >= FILE_ROWS * targets * rows.rdd.getNumPartitions()


def _write(table: DataFrame, path: str, run: str, balanced: bool) -> None:
    with shuffles_removed(table.sparkSession):
        write_by_target(table.withColumn("run", F.lit(run)), path, "run", codec=CODEC, balanced=balanced)


def _name(low: int, high: int) -> str:
    return f"b{low}-{high}"


def _record(spark: SparkSession, path: str, low: int, high: int) -> None:
    manifest.append(spark.createDataFrame([(low, high)], _RUN), f"{path}/runs")


def live_runs(spark: SparkSession, path: str) -> list[tuple[int, int]]:
    """First and last batch of the runs that make up the log, in order; a run that a wider one covers is not among them."""
    out: list[tuple[int, int]] = []
    for low, high in _told(spark, path):
        if not out or high > out[-1][1]:
            out.append((low, high))
    return out


def _told(spark: SparkSession, path: str) -> list[tuple[int, int]]:
    """All runs that were ever recorded, wider ones before those that they cover."""
    told = {(r.low, r.high) for r in manifest.read(spark, f"{path}/runs", _RUN).collect()}
    return sorted(told, key=lambda r: (r[0], -r[1]))


def read_log(spark: SparkSession, path: str, table: str = "vectors") -> DataFrame:
    """Current state of a streamed table: the last batch of each id."""
    return _merged(spark, path, table, live_runs(spark, path))


def _rows_of(spark: SparkSession, path: str, table: str, runs: list[tuple[int, int]]) -> DataFrame:
    return spark.read.parquet(f"{path}/{table}").filter(F.col("run").isin([_name(*r) for r in runs]))


def _merged(spark: SparkSession, path: str, table: str, runs: list[tuple[int, int]]) -> DataFrame:
    """The last batch of each id; an id stands once in a run, so the newest run goes through as it is."""
    runs = sorted(runs, key=lambda r: r[1])
    place = F.create_map(*[F.lit(x) for i, r in enumerate(runs) for x in (_name(*r), i)])

    def marked(some: list[tuple[int, int]]) -> DataFrame:
        rows = _rows_of(spark, path, table, some).withColumn("target", F.col("target").cast("string"))
        return rows.withColumns({"key": F.struct("target", "chunk_id"), "age": F.try_element_at(place, F.col("run"))}).drop("run")

    held = F.bit_count(F.bit_or(F.expr("shiftleft(1L, age % 63)")))  # runs that hold the key, or fewer
    told = marked(runs).groupBy("key").agg(F.max("age").alias("last"), F.count(F.lit(1)).alias("n"), held.alias("held"))
    told = stage(told.filter("n > 1"), "repeated")
    if not told.filter("n > held").isEmpty():  # targets that were written apart and read as one, like 7 and 07
        return dedupe_last(marked(runs).drop("key"), ["target", "chunk_id"], ["age"]).drop("age")
    newest = marked(runs[-1:]).drop("key", "age")
    if not runs[:-1]:
        return newest
    kept = join_dimension(marked(runs[:-1]), told.select("key", "last"), ["key"], "left").filter("last is null or last = age")
    return kept.drop("key", "age", "last").unionByName(newest)


def compact(spark: SparkSession, path: str, fanout: int = 4) -> list[tuple[int, int]]:
    """Merge neighbouring runs of one level, ``fanout`` at a time, into one of the next; the live runs after it.

    A run is of level n if it spans at least ``fanout`` ** n batches, so a row is
    written again once per level, and a merge reads only the runs that it joins.  The
    merged run counts from its record on, which comes after both tables; what
    it replaces stays in place for readers that began before, until ``vacuum``.
    """
    if fanout < 2:
        raise ValueError("a merge joins two runs or more")
    while (group := _mergeable(live_runs(spark, path), fanout)) is not None:
        low, high = group[0][0], group[-1][1]
        for table in TABLES:
            balanced = _balanced(_rows_of(spark, path, table, group))
            _write(_merged(spark, path, table, group), f"{path}/{table}", _name(low, high), balanced)
        _record(spark, path, low, high)
    return live_runs(spark, path)


def vacuum(spark: SparkSession, path: str) -> None:
    """Remove the rows of recorded runs that a merge has replaced; call it when no reader that began before that is left.

    Live runs, half-written ones and the records stay.
    """
    gone = {f"run={_name(*r)}" for r in set(_told(spark, path)) - set(live_runs(spark, path))}
    for table in TABLES if gone else ():
        root = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{table}")
        files = root.getFileSystem(spark._jsc.hadoopConfiguration())
        for target in (x.getPath() for x in files.listStatus(root) if x.isDirectory()):
            for run in (x.getPath() for x in files.listStatus(target)):
                if run.getName() in gone:
                    remove_folder(spark, run.toString())


def _mergeable(runs: list[tuple[int, int]], fanout: int) -> list[tuple[int, int]] | None:
    def level(run: tuple[int, int]) -> int:
        n = 0
        while fanout ** (n + 1) <= run[1] - run[0] + 1:
            n += 1
        return n

    for at in range(len(runs) - fanout + 1):
        group = runs[at : at + fanout]
        if len({level(r) for r in group}) == 1:
            return group
    return None
