"""Writing and reading builds: sorted files, parts a table, manifests, resume and merge."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


def work_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share; a local one only in a local session that names none."""
    shared = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        shared = "file://" + tempfile.mkdtemp(prefix="cubewright-")
    return f"{shared.rstrip('/')}/builds/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: what is derived from it reads that, and lost executors take nothing with them."""
    path = work_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def handed_out(df: DataFrame, most: int = 50_000) -> DataFrame:
    """``df``, stored or small, marked for broadcast if it has at most ``most`` rows: few keys then never gather another
    table's rows in as few tasks. A larger one joins by a shuffle."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def write_sorted(df: DataFrame, path: str, keys: list[str], partitions: int) -> None:
    """Range-partitioned and sorted within, in row groups of about 8 MB, so that readers skip by the leading keys. Spark's
    committer writes under temporary names and renames at the end, so a reader sees all files or none."""
    rows = df.repartitionByRange(partitions, *keys).sortWithinPartitions(*keys)
    rows.write.mode("overwrite").option("compression", "zstd").option("parquet.block.size", 8 << 20).parquet(path)


def write_parts(df: DataFrame, path: str, key: str) -> None:
    """A directory for each ``key``; those of other keys stay. Large tables are spread over files by AQE's rebalance, not
    gathered into one. The keys' directories are replaced when the job commits, all at once by rename."""
    rows = df.hint("rebalance", key).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    rows.option("compression", "zstd").partitionBy(key).parquet(path)


def done_parts(spark: SparkSession, path: str, key: str, kind: str = "string") -> DataFrame:
    """``key, rows, hash, tool`` of the parts under ``path`` that are whole: those with a row in its manifest."""
    schema = f"rows long, hash decimal(38,0), tool string, {key} {kind}"
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/manifest")
    if not folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(folder):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{path}/manifest")


def build_parts(df: DataFrame, path: str, key: str, tool: str, batches: int = 1) -> DataFrame:
    """Write the parts of ``df`` that are not done yet, and return the manifest of all: parts under ``path/parts``, a row for
    each under ``path/manifest``, which is what makes it done.

    A run goes through ``batches`` of keys. Each batch writes its parts and then, from what was written, its rows of the
    manifest; a run that ends in between loses no more than that batch, whose parts the next run replaces. A part whose
    row names another ``tool`` is written again. Keys of earlier runs that ``df`` lacks stay as they are.
    """
    spark, kind = df.sparkSession, df.schema[key].dataType.simpleString()
    columns = sorted(c for c in df.columns if c != key)
    for k in range(batches):
        done = done_parts(spark, path, key, kind).where(F.col("tool") == tool).select(key)
        rows = df.where(F.pmod(F.xxhash64(key), F.lit(batches)) == k).join(done, key, "left_anti")
        keys = stored(rows.select(key).distinct(), "pending-parts")
        if keys.isEmpty():
            continue
        write_parts(rows, f"{path}/parts", key)
        written = spark.read.schema(df.schema).parquet(f"{path}/parts").join(keys, key, "left_semi")
        write_parts(manifest(written, key, columns).withColumn("tool", F.lit(tool)), f"{path}/manifest", key)
    return done_parts(spark, path, key, kind)


def read_reference(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A reference CSV with an exact header; lists are ``;``-joined text for the caller to split."""
    return spark.read.csv(path, header=True, schema=schema, enforceSchema=False)


def read_code_set(spark: SparkSession, path: str, sha256: str | None = None) -> tuple[DataFrame, DataFrame]:
    """``code, en, fr, representation`` of a code set's JSON, codes as text; and its ``problem`` rows.

    Codes must all be numbers or all be texts, and the file's SHA-256 the expected one where that is given.
    """
    text = spark.read.text(path, wholetext=True)
    each = text.select(F.explode(F.from_json("value", "object array<string>")["object"]).alias("o"))
    rows = each.select(F.from_json("o", "code string, en string, fr string, representation string").alias("r"), F.col("o").rlike(r'"code"\s*:\s*"').alias("is_text"))
    kinds = rows.agg(F.count_distinct("is_text").alias("n")).where("n > 1").select(F.lit("codes of two types").alias("problem"))
    bad = text.where(F.sha2("value", 256) != F.lit(sha256 or "")).select(F.lit("another checksum").alias("problem")) if sha256 else kinds.limit(0)
    return rows.select("r.*"), kinds.union(bad)


def union_builds(parts: list[DataFrame]) -> tuple[DataFrame, DataFrame]:
    """One table of several builds without exact repeats, and one row that says how many there were."""
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    once = whole.distinct()
    counts = whole.agg(F.count("*").alias("rows")).join(once.agg(F.count("*").alias("kept")))
    return once, counts.select("rows", "kept", (F.col("rows") - F.col("kept")).alias("repeats"))


def content_hash(columns: list[str]) -> Column:
    """An order-free hash of all rows: the sum of 60-bit digests of their texts, so that repeated rows count each."""
    text = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in columns])
    return F.sum(F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("decimal(38,0)"))


def manifest(df: DataFrame, key: str, columns: list[str] | None = None) -> DataFrame:
    """Rows and content hash of each table, over the given columns or all others."""
    chosen = columns or [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.count("*").alias("rows"), content_hash(chosen).alias("hash"))


class FileHashes(DataSource):
    """``spark.read.format("filehashes").option("path", folder)``: ``path, bytes, sha256`` of every file under a folder, which
    Arrow's file systems can open (``file://`` or a plain path where it is mounted on all executors, ``hdfs://``, ``s3://``).

    Files are read in pieces of ``PIECE`` bytes, so their size is no matter. Small files share a partition up to ``SHARE``
    bytes; a larger one has its own. Names that begin with a dot or an underscore are left out.
    """

    PIECE, SHARE = 8 << 20, 256 << 20

    @classmethod
    def name(cls) -> str:
        return "filehashes"

    def schema(self) -> str:
        return "path string, bytes long, sha256 string"

    def reader(self, schema) -> DataSourceReader:
        return _HashReader(self.options["path"])


class _HashReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        system, root = fs.FileSystem.from_uri(self.path if "://" in self.path else f"file://{self.path}")
        found = [f for f in system.get_file_info(fs.FileSelector(root, recursive=True)) if f.type == fs.FileType.File and f.base_name[0] not in "._"]
        groups, size = [], 0
        for f in sorted(found, key=lambda f: (f.size, f.path)):
            if not groups or size + f.size > FileHashes.SHARE:
                groups.append([])
                size = 0
            groups[-1].append(f.path)
            size += f.size
        return [InputPartition(g) for g in groups]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        import hashlib

        from pyarrow import fs

        system, _ = fs.FileSystem.from_uri(self.path if "://" in self.path else f"file://{self.path}")
        for path in partition.value if partition else ():
            digest, size = hashlib.sha256(), 0
            with system.open_input_stream(path) as stream:
                while piece := stream.read(FileHashes.PIECE):
                    digest.update(piece)
                    size += len(piece)
            yield path, size, digest.hexdigest()


def file_manifest(spark: SparkSession, path: str) -> DataFrame:
    """``path, bytes, sha256`` of every file under ``path``, each streamed where it is read."""
    spark.dataSource.register(FileHashes)
    return spark.read.format("filehashes").option("path", path).load()


def build_record(reports: DataFrame, files: DataFrame, inputs: DataFrame, tool: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """A build's manifest and its summary.

    The manifest has a row for each table of ``reports`` (``pid, status, rows, warnings``): its written ``files`` and its
    ``inputs``, each ``pid, path, bytes, sha256``, as lists by path, the tool's names and versions, and what went wrong or
    was odd. A table without inputs or files has empty lists. The summary has ``status, tables, rows, bytes, warnings``.
    """
    listed = lambda df, name: df.groupBy("pid").agg(F.array_sort(F.collect_list(F.struct("path", "bytes", "sha256"))).alias(name))
    nothing = F.expr("array() :: array<struct<path: string, bytes: bigint, sha256: string>>")
    versions = F.create_map(*[F.lit(x) for kv in sorted(tool.items()) for x in kv]) if tool else F.expr("map() :: map<string, string>")
    rows = reports.join(listed(files, "files"), "pid", "left").join(listed(inputs, "inputs"), "pid", "left")
    rows = rows.select("pid", "status", "rows", *[F.coalesce(c, nothing).alias(c) for c in ("files", "inputs")], versions.alias("tool"), F.coalesce("warnings", F.array().cast("array<string>")).alias("warnings"))
    size = F.aggregate("files", F.lit(0).cast("long"), lambda n, f: n + f["bytes"])
    summary = rows.groupBy("status").agg(F.count("*").alias("tables"), F.sum("rows").alias("rows"), F.sum(size).alias("bytes"), F.sum(F.size("warnings")).alias("warnings"))
    return rows, summary


def reuse(expected: DataFrame, actual: DataFrame, tool: str, proofs: DataFrame) -> DataFrame:
    """``pid, reuse, why``: a build is reused only where its inputs' hashes, its tool and its proofs of null units all hold.

    ``expected`` has ``pid, path, hash, tool``; ``actual`` the files' ``path, hash``; ``proofs`` ``pid, proved``.
    """
    both = expected.join(actual.select("path", F.col("hash").alias("found")), "path", "left")
    inputs = both.groupBy("pid").agg(F.bool_and(F.col("hash").eqNullSafe(F.col("found"))).alias("same"), F.bool_and(F.col("tool") == tool).alias("tool"))
    rows = inputs.join(proofs, "pid", "left")
    why = F.when(~F.col("same"), "inputs").when(~F.col("tool"), "tool").when(~F.coalesce("proved", F.lit(False)), "proof")
    return rows.select("pid", why.isNull().alias("reuse"), F.coalesce(why, F.lit("")).alias("why"))


def pending_tables(requested: DataFrame, reports: DataFrame, files: DataFrame) -> DataFrame:
    """Requested tables without an ok report whose file has the recorded size."""
    done = reports.where("status = 'ok'").join(files, "pid").where("bytes = size").select("pid")
    return requested.join(done, "pid", "left_anti")


def verify_hashes(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Paths whose bytes or hash differ, or that are missing."""
    both = expected.join(actual.select("path", F.col("hash").alias("found")), "path", "left")
    return both.where(~F.col("hash").eqNullSafe(F.col("found"))).select("path", F.when(F.col("found").isNull(), "missing").otherwise("changed").alias("problem"))


def merge_manifests(a: DataFrame, b: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Tables of two builds with their build, and the ids that both hold."""
    whole = a.withColumn("build", F.lit("a")).unionByName(b.withColumn("build", F.lit("b")))
    twice = whole.groupBy("pid").agg(F.count("*").alias("n")).where("n > 1")
    return whole.join(twice, "pid", "left_anti"), twice


def merged_summary(a: DataFrame, b: DataFrame) -> DataFrame:
    """``status, tables, rows``: two builds' summaries added, each ``pid, status, rows``."""
    return a.unionByName(b).groupBy("status").agg(F.count("*").alias("tables"), F.sum("rows").alias("rows"))


def assemble_catalogue(rows: DataFrame, reports: DataFrame, order: list[str]) -> DataFrame:
    """Metadata rows of the tables whose report is ok, in order within each."""
    return rows.join(reports.where("status = 'ok'").select("pid"), "pid", "left_semi").sortWithinPartitions("pid", *order)


def export_csv(df: DataFrame, path: str) -> None:
    """Rows as CSV, lists and structures as JSON text."""
    flat = [F.to_json(c).alias(c) if t.startswith(("array", "struct", "map")) else F.col(c) for c, t in df.dtypes]
    df.select(*flat).write.mode("overwrite").csv(path, header=True)


def export_view(df: DataFrame, path: str, kind: str, provenance: DataFrame) -> None:
    """A view's points under ``path/points`` as Parquet, lists typed, or CSV; and where they come from under
    ``path/provenance`` as JSON lines."""
    if kind == "csv":
        export_csv(df, f"{path}/points")
    else:
        df.write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/points")
    provenance.write.mode("overwrite").json(f"{path}/provenance")
