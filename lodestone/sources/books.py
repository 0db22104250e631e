"""Books on disk: tolerant JSON tables, chunks of several layouts, nested collections, raw vectors, files as they come and tables that are made anew only when they must.

Reading goes through Spark's own readers; a malformed file or line gives no row or a null, never an error. Writing goes to a new folder each time, and a pointer file
names the one that holds, so readers see the old table or the new one.
"""

from __future__ import annotations

import json
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CHUNK = "chunk_id string, chunk_index long, text string, page_numbers array<int>, doc_items array<string>"


def read_lines(spark: SparkSession, paths: list[str], schema: str) -> DataFrame:
    """Rows of JSON lines; blank and malformed lines, and lines that are no object, are left out."""
    lines = spark.read.text(paths).where(F.trim("value").startswith("{"))
    parsed = lines.select(F.from_json("value", T.StructType([*T._parse_datatype_string(schema).fields, T.StructField("__bad", T.StringType())]), {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "__bad"}).alias("r"))
    return parsed.where("r IS NOT NULL AND r.__bad IS NULL").select("r.*").drop("__bad")


def read_documents(spark: SparkSession, paths: list[str], schema: str) -> DataFrame:
    """path and the fields of one JSON object a file; malformed files and other values give a row of nulls."""
    files = spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    return files.withColumn("r", F.from_json("value", schema)).select("path", "r.*")


def chunks_of(payload: Column) -> Column:
    """The chunks of an answer in any of its layouts: chunks, document.chunks, result.chunks, or a bare list."""
    kind = f"array<struct<{CHUNK.replace(' ', ':').replace(',:', ',')}>>"
    at = lambda path: F.from_json(F.get_json_object(payload, path), kind)
    bare = F.when(F.trim(payload).startswith("["), F.from_json(payload, kind))
    return F.coalesce(at("$.chunks"), at("$.document.chunks"), at("$.result.chunks"), bare, F.expr(f"cast(array() AS {kind})"))


def pictures_of(documents: DataFrame, pictures: str) -> DataFrame:
    """path, index, class, confidence of each picture: the most confident prediction, whichever of two layouts it stands in."""
    p = documents.select("path", F.posexplode(pictures).alias("index", "p"))
    both = F.concat(F.coalesce("p.meta.classification.predictions", F.array()), F.coalesce("p.annotations", F.array()))
    best = F.array_max(F.transform(F.filter(both, lambda x: x["class_name"].isNotNull()), lambda x: F.struct(F.coalesce(x["confidence"], F.lit(0.0)).alias("confidence"), x["class_name"].alias("class"))))
    return p.select("path", "index", best["class"].alias("class"), best["confidence"].alias("confidence"))


def uris(text: Column) -> Column:
    """Every uri in a JSON text, at whatever depth."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(r'"uri"\s*:\s*("(?:[^"\\]|\\.)*")'), F.lit(1)), lambda s: F.from_json(F.concat(F.lit("["), s, F.lit("]")), "array<string>")[0]))


def missing_members(documents: DataFrame, members: DataFrame) -> DataFrame:
    """path, uri of relative references in documents (path, text) that no member (path, member) of their archive answers."""
    asked = documents.select("path", F.explode(uris(F.col("text"))).alias("uri")).where(~F.col("uri").rlike("^(?:[a-zA-Z][a-zA-Z0-9+.-]*:|#|/)"))
    there = members.select("path", F.regexp_replace("member", r"^\./", "").alias("uri"))
    return asked.withColumn("uri", F.regexp_replace("uri", r"^\./", "")).join(there, ["path", "uri"], "left_anti")


def read_vectors(spark: SparkSession, paths: list[str], dim: int) -> DataFrame:
    """path, row, embedding of raw little-endian float32 files; a file that isn't whole rows is an error. One file is held at a time."""

    def run(batches):
        for b in batches:
            for path, content in zip(b.column("path").to_pylist(), b.column("content").to_pylist(), strict=True):
                if len(content) % (4 * dim):
                    raise ValueError(f"{path} holds no whole rows of {dim} numbers")
                x = np.frombuffer(content, "<f4").reshape(-1, dim)
                for a in range(0, len(x), 4_096):
                    part = x[a : a + 4_096]
                    listed = pa.ListArray.from_arrays(pa.array(np.arange(len(part) + 1) * dim, pa.int32()), pa.array(part.ravel()))
                    yield pa.RecordBatch.from_arrays([pa.array([path] * len(part)), pa.array(np.arange(a, a + len(part))), listed], ["path", "row", "embedding"])

    files = spark.read.format("binaryFile").load(paths).select("path", "content")
    return files.mapInArrow(run, "path string, row long, embedding array<float>")


def arrivals(spark: SparkSession, folder: str, suffixes: list[str]) -> DataFrame:
    """A stream of files with one of the suffixes as they come into a folder, hidden ones left out: filename, path, size, modified, sha256. Spark's file log sees each file once; equal contents under one name count once."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").load(folder)
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    files = files.select(name.alias("filename"), "path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"), F.sha2("content", 256).alias("sha256"))
    return files.where(~F.col("filename").startswith(".") & F.lower(F.regexp_extract("filename", r"(\.[^.]+)$", 1)).isin(suffixes)).dropDuplicates(["filename", "sha256"])


def stable(seen: DataFrame, seconds: float) -> DataFrame:
    """seen (filename, size, modified, at): the files whose last size and time have stood for that long."""
    signature = F.struct("size", "modified")
    last = seen.groupBy("filename").agg(F.max_by(signature, "at").alias("s"), F.max("at").alias("now"))
    since = seen.select("filename", signature.alias("s"), "at").join(last, ["filename", "s"]).groupBy("filename", "s", "now").agg(F.min("at").alias("since"))
    return since.where(F.col("now") - F.col("since") >= seconds).select("filename", "s.*")


def changed(files: DataFrame, known: DataFrame) -> DataFrame:
    """Files (path, modified, size) whose signature isn't the known one."""
    return files.join(known.select("path", "modified", "size"), ["path", "modified", "size"], "left_anti")


def generation(manifest_sha: Column, routes: Column) -> Column:
    return F.sha2(F.concat(manifest_sha, F.lit("\n"), routes), 256)


def publish(df: DataFrame, folder: str, fingerprint: str) -> str:
    """Writes the rows as a new generation below ``folder`` and points at it when they are all there. Nothing is written if the pointer names this fingerprint already."""
    spark = df.sparkSession
    now = pointer(spark, folder)
    if now and now["fingerprint"] == fingerprint:
        return now["path"]
    path = f"{folder}/generation={uuid.uuid4().hex}"
    df.write.parquet(path)
    said = json.dumps({"path": path, "fingerprint": fingerprint})
    spark.createDataFrame([(said,)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/current")
    return path


def pointer(spark: SparkSession, folder: str) -> dict | None:
    """The generation that holds, or none."""
    from py4j.protocol import Py4JJavaError
    from pyspark.errors import AnalysisException

    try:
        rows = spark.read.text(f"{folder}/current").collect()
    except (AnalysisException, Py4JJavaError):
        return None
    return json.loads(rows[0].value) if rows else None


def read_current(spark: SparkSession, folder: str) -> DataFrame:
    now = pointer(spark, folder)
    if now is None:
        raise FileNotFoundError(f"{folder} has no generation")
    return spark.read.parquet(now["path"])


def fingerprint(rows: DataFrame, columns: list[str], *more: str) -> str:
    """A SHA-256 of the rows, whatever their order, and of what else the result depends on."""
    each = rows.select(F.xxhash64(*columns).alias("a"), F.xxhash64(F.lit(7), *columns).alias("b"))
    got = each.agg(F.count("*"), F.sum(F.col("a").cast("decimal(38,0)")), F.sum(F.col("b").cast("decimal(38,0)"))).first()
    import hashlib

    return hashlib.sha256("\0".join([*map(str, got), *more]).encode()).hexdigest()
