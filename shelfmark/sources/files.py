"""Reading candidate files and exporting chosen ones."""

import hashlib

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.functions.documents import address_of, content_hash, has_pdf_magic
from shelfmark.plans.skew import few_against_many
from shelfmark.sources.snapshots import publish_audited


PDF_NAMES = "*.[pP][dD][fF]"
PIECE_BYTES = 8 << 20
READERS = 2_000


def scan_files(spark: SparkSession, path: str, names: str = PDF_NAMES) -> DataFrame:
    """``.pdf`` files below ``path`` with their bytes and, for files that cannot be read, a failure.

    Columns: ``path, modificationTime, length, content, failure_code, failure_detail``. Spark reads a file's
    bytes up to ``spark.sql.sources.binaryFile.maxLength``; a larger file is listed without its content. Spark lists no empty files;
    ``classify_intake`` reports them as missing when they were asked for.
    """
    files = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", names)
        .option("recursiveFileLookup", "true")
        .load(path)
    )
    limit = int(spark.conf.get("spark.sql.sources.binaryFile.maxLength"))
    none = F.lit(None).cast("string")
    readable = files.where(F.col("length") <= limit).select(
        "path", "modificationTime", "length", "content", none.alias("failure_code"), none.alias("failure_detail"))
    large = files.where(F.col("length") > limit).select(
        "path", "modificationTime", "length", F.lit(None).cast("binary").alias("content"),
        F.lit("unsupported_feature").alias("failure_code"), F.lit(f"file exceeds {limit} bytes").alias("failure_detail"))
    return readable.unionByName(large)


def open_file(path: str):
    """An input stream for a path as Spark lists it, on any file system that Arrow reaches."""
    scheme, found, rest = path.partition(":")
    if not found or scheme == "file" or "/" in scheme:
        return fs.LocalFileSystem().open_input_stream("/" + rest.lstrip("/") if scheme == "file" else path)
    host, _, name = rest.removeprefix("//").partition("/")
    system, base = fs.FileSystem.from_uri(f"{scheme}://{host}/")
    return system.open_input_stream(f"{base.rstrip('/')}/{name}")


def hash_files(files: DataFrame, piece_bytes: int = PIECE_BYTES) -> DataFrame:
    """``path, size_bytes, content_hash, relative_path, is_pdf, failure_detail`` of scanned files of any size.

    ``files`` comes from ``scan_files``. Files within Spark's limit are hashed where they are read; a larger one is read
    in pieces of ``piece_bytes`` by one task, which never holds more than a piece of it. Large files are spread over up to
    ``READERS`` tasks. A file that cannot be opened or read to its end gives a row without hash that says why, and so
    does a file that has another length than was listed.
    """
    within = files.where(F.col("content").isNotNull()).select(
        "path", F.col("length").cast("bigint").alias("size_bytes"), content_hash(F.col("content")).alias("content_hash"),
        has_pdf_magic(F.col("content")).alias("is_pdf"), F.lit(None).cast("string").alias("failure_detail"))
    large = files.where(F.col("content").isNull()).select("path", F.col("length").cast("bigint").alias("size_bytes"))

    def digest(path: str, size: int) -> tuple:
        state, read, head = hashlib.sha256(), 0, b""
        try:
            with open_file(path) as stream:
                while piece := stream.read(piece_bytes):
                    head = (head + piece[:16])[:16]
                    read += len(piece)
                    state.update(piece)
        except (OSError, ValueError) as error:  # Arrow's errors are among them
            return None, None, str(error)
        if size is not None and read != size:
            return None, None, f"file has {read} bytes and was listed with {size}"
        return state.hexdigest(), head, None

    def run(batches):
        for part in batches:
            found = [digest(p, n) for p, n in zip(
                part.column("path").to_pylist(), part.column("size_bytes").to_pylist(), strict=True)]
            hashes, heads, failures = zip(*found, strict=True) if found else ([], [], [])
            yield pa.RecordBatch.from_arrays(
                [part.column("path"), part.column("size_bytes"), pa.array(hashes, pa.string()), pa.array(heads, pa.binary()),
                 pa.array(failures, pa.string())], ["path", "size_bytes", "content_hash", "head", "failure_detail"])

    readers = min(max(large.count(), 1), READERS)
    streamed = large.repartition(readers, "path").mapInArrow(
        run, "path string, size_bytes bigint, content_hash string, head binary, failure_detail string")
    rows = within.unionByName(streamed.withColumn("is_pdf", has_pdf_magic(F.col("head"))).drop("head"))
    return rows.select("path", "size_bytes", "content_hash", address_of(F.col("content_hash")).alias("relative_path"),
                       "is_pdf", "failure_detail")


def export_subset(library: DataFrame, ids: DataFrame, contents: DataFrame, target: str) -> int:
    """Copy chosen documents out; returns the published version.

    ``contents`` is ``(storage_key, content)``. The export is rejected unless every chosen
    document is written with exactly its recorded size; the library is only read.
    """
    chosen = library.join(ids.select("doc_id").distinct(), "doc_id", "left_semi").select(
        "doc_id", "storage_key", "display_name", "size_bytes"
    )
    out = few_against_many(chosen, contents.select("storage_key", "content"), ["storage_key"], ["doc_id"])
    expected = chosen.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("b")).first()

    def complete(written: DataFrame) -> bool:
        got = written.agg(
            F.count(F.lit(1)),
            F.coalesce(F.sum(F.octet_length("content")), F.lit(0)),
            F.count_if(F.octet_length("content") != F.col("size_bytes")),
        ).first()
        return (got[0], got[1], got[2]) == (expected["n"], expected["b"], 0)

    return publish_audited(library.sparkSession, lambda: out, target, complete, allow_empty=True)
