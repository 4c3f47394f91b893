"""Reading candidate documents."""

from __future__ import annotations

import os
import re
import stat
import uuid
import zlib
from collections.abc import Iterator
from contextlib import suppress

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from docwarden.functions.paths import normalize_path
from docwarden.functions.times import iso_utc
from docwarden.session import materialize


def scan_corpus(
    spark: SparkSession, root: str, *, glob: str | None = None, candidates: DataFrame | None = None
) -> DataFrame:
    """Files below a root with size, modification time, bytes and their hash; hidden and empty ones are left out.

    Spark's reader lists all files in the driver and plans tasks of few files each, so the driver's memory
    grows with their number. Below a local root tasks list the folders and read the files instead."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    files_of = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    where = files_of.makeQualified(path)
    if where.toUri().getScheme() == "file" and files_of.isDirectory(path):
        return _scan_local(spark, where.toUri().getPath(), glob, candidates)
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    above = where.toString().rstrip("/") + "/"
    # The root is cut off the front once; its name may come again below it.
    relative = F.when(F.col("path").startswith(above), F.substring("path", len(above) + 1, 1 << 30)).otherwise(
        F.raise_error(F.concat(F.lit("file outside the root: "), "path"))
    )
    files = reader.load(root).select(
        relative.alias("relative_path"),
        "content",
        F.col("length").alias("size"),
        iso_utc(F.col("modificationTime")).alias("source_modified_at"),
        F.sha2("content", 256).alias("source_sha256"),
    )
    return candidate_filter(files, candidates) if candidates is not None else files


LISTED_ENTRIES = 1 << 16
#: A task goes down into the folders that it finds until it has listed so many entries.
TASK_FILES, TASK_BYTES = 1 << 14, 128 << 20
TASKS_PER_CORE = 4
READ_BYTES = 4 << 20
#: Of files that a worker holds at once, unless a single one is larger.


def _scan_local(spark: SparkSession, folder: str, glob: str | None, candidates: DataFrame | None) -> DataFrame:
    """Candidates are looked up among the listed paths, so only chosen files are read."""
    listed, tasks = _list_local(spark, folder, glob)
    if candidates is None:
        return _read_local(listed, folder, tasks)
    chosen = candidate_filter(listed, candidates)
    present = _read_local(chosen.filter("NOT missing").drop("missing"), folder, tasks)
    return present.withColumn("missing", F.lit(False)).unionByName(chosen.filter("missing"), allowMissingColumns=True)


def _list_local(spark: SparkSession, folder: str, glob: str | None) -> tuple[DataFrame, int]:
    """Paths of the files that Spark's reader would find below a local folder, and a number of tasks to read
    them. Each round is written: tasks list folders, and those that they leave are dealt to the next."""
    wanted = spark._jvm.org.apache.hadoop.fs.GlobPattern.compile(glob or "*").pattern()

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name_fits, seen, rows = re.compile(wanted, re.DOTALL).fullmatch, 0, []
        flush = lambda: pa.RecordBatch.from_arrays(
            [pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.string(), pa.int64()), strict=True)], ["relative_path", "size"]
        )
        for batch in batches:
            for top in batch.column(0).to_pylist():
                ahead = [top]
                while ahead:
                    at = ahead.pop()
                    with os.scandir(os.path.join(folder, at)) as entries:
                        for entry in entries:
                            seen += 1
                            below, found = os.path.join(at, entry.name), None
                            with suppress(OSError):  # gone, or a link to nothing
                                found = entry.stat()
                            if found is None:
                                continue
                            if stat.S_ISDIR(found.st_mode):
                                if not _hidden(entry.name) or entry.name.startswith(("_metadata", "_common_metadata")):
                                    if seen < LISTED_ENTRIES:
                                        ahead.append(below)
                                    else:
                                        rows.append((below, None))
                            elif stat.S_ISREG(found.st_mode) and found.st_size and not _hidden(entry.name) and name_fits(entry.name):
                                rows.append((below, found.st_size))
                            if len(rows) >= 8192:
                                yield flush()
                                rows.clear()
                    if seen >= LISTED_ENTRIES:
                        rows += [(x, None) for x in ahead]
                        ahead.clear()
        if rows:
            yield flush()

    cores = spark.sparkContext.defaultParallelism
    level, found, files, size = spark.createDataFrame([("",)], "relative_path string"), [], 0, 0
    while True:
        listed = materialize(level.mapInArrow(walk, "relative_path string, size long"), "listed")
        found.append(listed.filter("size IS NOT NULL").select("relative_path"))
        n, full, total = listed.agg(F.count("*"), F.count("size"), F.coalesce(F.sum("size"), F.lit(0))).head()
        files, size = files + full, size + total
        if n == full:
            break
        level = listed.filter("size IS NULL").select("relative_path").repartition(min(n - full, TASKS_PER_CORE * cores))
    while len(found) > 1:
        found = [a.unionByName(b[0]) if b else a for a, *b in (found[i : i + 2] for i in range(0, len(found), 2))]
    return found[0], max(1, min(files, TASKS_PER_CORE * cores), -(-files // TASK_FILES), -(-size // TASK_BYTES))


def _hidden(name: str) -> bool:
    """Whether Spark's readers leave a file of this name out."""
    return name.startswith(".") or name.startswith("_") and "=" not in name or name.endswith("._COPYING_")


def _read_local(paths: DataFrame, folder: str, tasks: int) -> DataFrame:
    """The listed files, read once each."""

    @F.arrow_udf("size long, modified long, content binary")
    def read(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        kinds = {"size": pa.int64(), "modified": pa.int64(), "content": pa.binary()}
        for batch in batches:
            held, size = [], 0
            for path in batch.to_pylist():
                with open(os.path.join(folder, path), "rb") as file:
                    now = os.fstat(file.fileno())
                    held.append((now.st_size, now.st_mtime_ns // 1_000_000 * 1000, file.read()))
                _check_sums(os.path.join(folder, path), held[-1][2])
                size += len(held[-1][2])
                if size >= READ_BYTES:
                    yield _structs(held, kinds)
                    held, size = [], 0
            if held:
                yield _structs(held, kinds)

    # A file may change, so the function counts as not deterministic: no filter reads it a second time.
    files = paths.repartition(tasks).select("relative_path", read.asNondeterministic()("relative_path").alias("_file"))
    return files.select(
        "relative_path",
        "_file.content",
        "_file.size",
        iso_utc(F.timestamp_micros("_file.modified")).alias("source_modified_at"),
        F.sha2("_file.content", 256).alias("source_sha256"),
    )


def _check_sums(path: str, content: bytes) -> None:
    """Hold a file against the checksum file that Hadoop's local file system may have written beside it."""
    folder, name = os.path.split(path)
    try:
        with open(f"{folder}/.{name}.crc", "rb") as file:
            sums = file.read()
    except OSError:
        return
    step = int.from_bytes(sums[4:8], "big")
    if sums[:4] != b"crc\0" or not step:
        return
    for i, k in zip(range(0, len(content), step), range(8, len(content) + len(sums), 4)):
        if zlib.crc32(content[i : i + step]).to_bytes(4, "big") != sums[k : k + 4]:
            raise ValueError(f"checksum error: {path} at {i}")


def _structs(rows: list[tuple], kinds: dict[str, pa.DataType]) -> pa.StructArray:
    columns = [pa.array(x, kind) for x, kind in zip(zip(*rows, strict=True), kinds.values(), strict=True)]
    return pa.StructArray.from_arrays(columns, list(kinds))


FOLDER_FILES = 4096
#: Files of one folder, so that a reader lists many folders side by side instead of one in the driver.


def write_text_files(texts: DataFrame, root: str) -> int:
    """Write every row of ``text`` as a file of its own with a line end (a null: the line end alone), and
    return their number.

    Hadoop's local file system without its native library starts a process for every file it makes, to set
    the permissions; below a local root the tasks therefore open the files themselves. A file gets its name
    when it is whole, and the same one if its task runs again."""
    spark = texts.sparkSession
    texts = texts.select(F.col("text").cast("string").alias("text"))
    home = spark._jvm.org.apache.hadoop.fs.Path(root)
    files_of = home.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    files_of.mkdirs(home)
    where = files_of.makeQualified(home).toUri()
    if where.getScheme() != "file":
        texts.write.mode("append").option("maxRecordsPerFile", 1).text(root)
        return texts.count()
    folder = where.getPath()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n = TaskContext.get().partitionId(), 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                at = f"{folder}/part-{part:05d}-{n // FOLDER_FILES:05d}"
                if n % FOLDER_FILES == 0:
                    os.makedirs(at, exist_ok=True)
                half = f"{at}/.{uuid.uuid4().hex}"
                with open(half, "wb") as file:
                    file.write((text or "").encode() + b"\n")
                os.replace(half, f"{at}/{n:09d}.txt")
                n += 1
        yield pa.RecordBatch.from_pydict({"files": pa.array([n], pa.int64())})

    return texts.mapInArrow(write, "files long").agg(F.coalesce(F.sum("files"), F.lit(0))).head()[0]


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """A corpus kept as a table."""
    return spark.read.parquet(path)


BUCKETS = 200


def write_bucketed_corpus(corpus: DataFrame, table: str, folder: str, *, buckets: int = BUCKETS) -> DataFrame:
    """Keep a corpus as a table of buckets by path, each sorted by path, and return it.

    Entries, candidates and roles are joined to contents by path. Over this table such a join moves the
    narrow side alone, as long as a shuffle has no more partitions than the table has buckets: contents
    are read bucket by bucket where they lie. Give as many buckets as keep one within a task's memory."""
    dealt = corpus.repartition(buckets, "relative_path")
    dealt.write.bucketBy(buckets, "relative_path").sortBy("relative_path").option("path", folder).saveAsTable(table)
    return corpus.sparkSession.table(table)


def open_bucketed_corpus(spark: SparkSession, table: str, folder: str, schema: str, *, buckets: int = BUCKETS) -> DataFrame:
    """The same table in a session whose catalog does not know it yet."""
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS {table} ({schema}) USING parquet OPTIONS (path '{folder}')"
        f" CLUSTERED BY (relative_path) SORTED BY (relative_path) INTO {int(buckets)} BUCKETS"
    )
    return spark.table(table)


def candidate_filter(corpus: DataFrame, candidates: DataFrame) -> DataFrame:
    """Restrict a corpus to listed paths; a listed path that is absent stays as ``missing``."""
    listed = candidates.select(
        F.coalesce(normalize_path(F.col("relative_path")), F.col("relative_path")).alias(
            "relative_path"
        )
    ).distinct()
    # Paths alone decide what is missing, so the contents are shuffled only if the list is too
    # large to be broadcast.
    present = corpus.join(listed, "relative_path", "left_semi").withColumn("missing", F.lit(False))
    missing = listed.join(corpus.select("relative_path"), "relative_path", "left_anti").withColumn(
        "missing", F.lit(True)
    )
    return present.unionByName(missing, allowMissingColumns=True)


def candidate_violations(candidates: DataFrame) -> DataFrame:
    """Empty, unsafe and repeated candidates."""
    path = F.col("relative_path")
    single = candidates.select(
        path,
        F.when(path.isNull() | (path == ""), "empty")
        .when(normalize_path(path).isNull(), "outside_root")
        .alias("violation"),
    ).filter("violation IS NOT NULL")
    repeated = (
        candidates.groupBy("relative_path")
        .agg(F.count("*").alias("n"))
        .filter("n > 1")
        .select("relative_path", F.lit("duplicate").alias("violation"))
    )
    return single.unionByName(repeated)
