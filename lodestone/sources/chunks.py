"""Chunk indexes (JSON lines) and archives with a document inside, as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions.text import tokens

CHUNK = """chunk_id string, chunk_index int, text string, raw_text string, num_tokens int, headings array<string>, doc_items array<string>,
page_numbers array<int>, source_filename string, postprocess_job_id long, quality_score int, content_type string"""


def read_index(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Rows of JSONL indexes: blank lines and lines that are no object are dropped; tokens and heading tokens are derived."""
    rows = spark.read.schema(CHUNK + ", _bad string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").json(paths)
    rows = rows.where("_bad IS NULL AND (chunk_id IS NOT NULL OR text IS NOT NULL)").drop("_bad")
    return rows.withColumn("tokens", tokens(F.col("text"))).withColumn("heading_tokens", tokens(F.array_join(F.coalesce("headings", F.array().cast("array<string>")), " ")))


def write_index(rows: DataFrame, path: str) -> None:
    """Replaces an index; Spark's commit protocol makes the files appear together."""
    rows.drop("tokens", "heading_tokens").write.mode("overwrite").json(path)


#: What an archive may hold: bytes of one member when unpacked, and of an archive that is read whole.
MOST_MEMBER, MOST_ARCHIVE = 64 << 20, 1 << 30
#: Bytes of a member that are unpacked at once.
PIECE = 1 << 20
_MEMBERS = "path string, member string, size long, status string, document string"


def _unpacked(archive, info, most: int) -> tuple[str, bytes | None]:
    """A member's status and, if it is a JSON of no more than ``most`` bytes, its bytes. It is unpacked in pieces whose check sum is worked out on the way; sizes that an archive states are not trusted."""
    import zipfile
    import zlib

    wanted, kept, size = info.filename.lower().endswith(".json"), [], 0
    if info.flag_bits & 1:
        return "encrypted", None
    try:
        with archive.open(info) as member:
            while piece := member.read(PIECE):
                size += len(piece)
                if size > most:
                    return "too_large", None
                if wanted:
                    kept.append(piece)
    except NotImplementedError:
        return "unknown_method", None
    except (zipfile.BadZipFile, zlib.error, EOFError, OSError, ValueError):
        return "damaged", None
    return "ok", b"".join(kept) if wanted else None


def _document(body: bytes) -> str | None:
    import json

    try:
        got = json.loads(body)
    except (ValueError, RecursionError):
        return None
    return json.dumps(got) if isinstance(got, dict) and isinstance(got.get("texts"), list) else None


def archive_members(spark: SparkSession, paths: list[str], most: int = MOST_MEMBER, largest: int = MOST_ARCHIVE, opener=None) -> DataFrame:
    """(path, member, size, status, document): members of ZIP archives; document is the text of a JSON object with a list ``texts``.

    status: ``ok``; ``too_large`` (more than ``most`` bytes when unpacked, whatever the archive says); ``damaged`` (check sum or data); ``encrypted``;
    ``unknown_method``. A file that is no archive gives one row without a member and ``no_archive``; one of more than ``largest`` bytes ``archive_too_large``, and is
    not read. ``opener``: a function from a path to a seekable binary file, for stores that Python can read by ranges: then only the directory at the end of an archive
    and its members are read, a piece at a time. Without it Spark reads each archive as a whole.
    """
    import pyarrow as pa

    def run(batches):
        import io
        import zipfile

        for b in batches:
            columns = [b.column(k).to_pylist() for k in range(b.num_columns)]
            for path, length, *data in zip(*columns, strict=True):
                out = []
                try:
                    with opener(path) if opener else io.BytesIO(data[0]) as f, zipfile.ZipFile(f) as z:
                        for info in z.infolist():
                            status, body = _unpacked(z, info, most)
                            out.append((path, info.filename, info.file_size, status, _document(body) if body is not None else None))
                except (zipfile.BadZipFile, OSError, ValueError):
                    out = [(path, None, length, "no_archive", None)]
                for k in range(0, len(out), 100):  # documents may be large
                    yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out[k : k + 100]], t) for c, t in enumerate((pa.string(), pa.string(), pa.int64(), pa.string(), pa.string()))], names=["path", "member", "size", "status", "document"])

    files = spark.read.format("binaryFile").load(paths)
    fits = files.where(F.col("length") <= largest)
    read = fits.select("path", "length") if opener else fits.select("path", "length", "content")
    over = files.where(F.col("length") > largest).select("path", F.lit(None).cast("string").alias("member"), F.col("length").alias("size"), F.lit("archive_too_large").alias("status"), F.lit(None).cast("string").alias("document"))
    return read.mapInArrow(run, _MEMBERS).unionByName(over)


def integrity(members: DataFrame) -> DataFrame:
    """path, members, damaged, found, member, references, internal, missing, status of each archive.

    status: ``no_archive``, ``damaged`` (a member that can't be read to its end), ``no_document``, ``several_documents``, ``warning`` (the document refers to members
    that aren't there) or ``ok``. References to other places and embedded data are counted, not followed.
    """
    from lodestone.sources.books import uris

    bad = F.col("status").isin("damaged", "encrypted", "unknown_method", "too_large")
    n = members.groupBy("path").agg(F.count("member").alias("members"), F.count_if(bad).alias("damaged"), F.count("document").alias("found"), F.min("member").alias("any"), F.max(F.when(F.col("document").isNotNull(), F.col("member"))).alias("member"))
    asked = members.where("document IS NOT NULL").select("path", F.explode(uris(F.col("document"))).alias("uri"))
    plain = lambda c: F.regexp_replace(F.replace(c, F.lit("\\"), F.lit("/")), r"^[./]+", "")
    inner = asked.withColumn("inner", ~F.col("uri").rlike("^[a-zA-Z][a-zA-Z0-9+.-]*:")).withColumn("name", plain(F.coalesce(F.try_url_decode(F.replace("uri", F.lit("+"), F.lit("%2B"))), F.col("uri"))))
    there = members.where("member IS NOT NULL").select("path", F.regexp_replace("member", r"^[./]+", "").alias("name"), F.lit(1).alias("there")).distinct()
    refs = inner.join(there, ["path", "name"], "left").groupBy("path").agg(F.count("*").alias("references"), F.count_distinct(F.when(F.col("inner") & (F.col("name") != ""), F.col("name"))).alias("internal"), F.count_distinct(F.when(F.col("inner") & (F.col("name") != "") & F.col("there").isNull(), F.col("name"))).alias("missing"))
    j = n.join(refs, "path", "left").na.fill(0, ["references", "internal", "missing"])
    status = F.when(F.col("any").isNull(), "no_archive").when(F.col("damaged") > 0, "damaged").when(F.col("found") == 0, "no_document").when(F.col("found") > 1, "several_documents").when(F.col("missing") > 0, "warning").otherwise("ok")
    return j.select("path", "members", "damaged", "found", F.when(F.col("found") == 1, F.col("member")).alias("member"), "references", "internal", "missing", status.alias("status"))


def documents(members: DataFrame) -> DataFrame:
    """(path, member, document) of archives with exactly one document; others are told apart by ``found``."""
    n = members.groupBy("path").agg(F.count("document").alias("found"))
    one = members.where("document IS NOT NULL").groupBy("path").agg(F.min("member").alias("member"), F.min("document").alias("document"))
    return n.join(one, "path", "left").select("path", "found", F.when(F.col("found") == 1, F.col("member")).alias("member"), F.when(F.col("found") == 1, F.col("document")).alias("document"))
