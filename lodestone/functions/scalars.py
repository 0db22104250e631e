"""Small values: safe numbers, slugs, stable ids, names of books and pages, pointers, headings, labels, citations, kinds of pages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Numbering of headings, by scheme, and citation labels.
DECIMAL = r"^\s*(\d+(?:\.\d+){1,5})(?=\s|\.|$)"
ALPHA_DECIMAL = r"^\s*([A-Z](?:\.\d+){1,5})(?=\s|\.|$)"
CHAPTER = r"(?i)^\s*(?:chapter|section)\s+(?:\d+|[IVXLCDM]+)\b"
APPENDIX = r"(?i)^\s*appendix\s+(?:[A-Z]|\d+|[IVXLCDM]+)\b"
ROMAN = r"^\s*([IVXLCDM]+)(?:\.|\s)(?=\s*[A-Z0-9])"
CITATION = r"\[([SV]\d+)\]"


def unit_interval(value: Column, default: float = 0.0) -> Column:
    """A number of any text held within 0 and 1; the default for what is no number."""
    n = value.try_cast("double")
    return F.when(n.isNull(), F.lit(default)).when(F.isnan(n), 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), n)))


def slug(value: Column, limit: int = 48, empty: str = "equipment") -> Column:
    s = F.substring(F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(value, F.lit(""))), "[^a-z0-9]+", "-"), "^-+|-+$", ""), 1, limit)
    return F.when(s == "", empty).otherwise(s)


def book_name(value: Column) -> Column:
    name = F.trim(F.coalesce(F.nullif(value, F.lit("")), F.lit("Unknown source")))
    return F.regexp_replace(name, r"(?i)\.(?:pdf|zip)$", "")


def page_label(pages: Column) -> Column:
    shown = F.array_join(F.transform(pages, lambda p: p.cast("string")), ", ")
    return F.coalesce(F.nullif(shown, F.lit("")), F.lit("unknown"))


def table_id(table: Column, page: Column, window: Column) -> Column:
    return F.format_string("TBL-%06d-P%04d-%03d", table, page, window)


def visual_id(job: Column, picture: Column) -> Column:
    return F.format_string("V-%s-%06d", job.cast("string"), picture)


def pointer(ref: Column) -> Column:
    """struct(collection, place) of a reference such as ``#/texts/12``; null for anything else."""
    m = F.regexp_extract(ref, r"^#/([a-z_]+)/(\d+)$", 1)
    return F.when(m != "", F.struct(m.alias("collection"), F.regexp_extract(ref, r"^#/([a-z_]+)/(\d+)$", 2).try_cast("int").alias("place")))


def utf16_length(value: Column) -> Column:
    return (F.octet_length(F.encode(value, "UTF-16LE")) / 2).cast("long")


def heading(text: Column) -> Column:
    """struct(scheme, depth) of a numbered heading; null for others, and for a bare number, which mostly is a list's."""
    t = F.regexp_replace(F.trim(F.coalesce(text, F.lit(""))), r"\s+", " ")
    sign = lambda scheme, depth: F.struct(F.lit(scheme).alias("scheme"), depth.cast("int").alias("depth"))
    dots = lambda p: F.size(F.split(F.regexp_extract(t, p, 1), r"\."))
    chain = F.when(t.rlike(DECIMAL), sign("decimal", dots(DECIMAL))).when(t.rlike(ALPHA_DECIMAL), sign("alpha_decimal", dots(ALPHA_DECIMAL)))
    return chain.when(t.rlike(CHAPTER), sign("chapter_section", F.lit(1))).when(t.rlike(APPENDIX), sign("appendix", F.lit(1))).when(t.rlike(ROMAN), sign("roman", F.lit(1)))


def citations(answer: Column, labels: Column) -> Column:
    """struct(valid, invalid, grounded): labels cited in an answer, each once in order, and whether all of them were supplied and there is one."""
    seen = F.array_distinct(F.regexp_extract_all(F.upper(F.coalesce(answer, F.lit(""))), F.lit(CITATION), F.lit(1)))
    valid, invalid = F.array_intersect(seen, labels), F.array_except(seen, labels)
    return F.struct(valid.alias("valid"), invalid.alias("invalid"), ((F.size(invalid) == 0) & (F.size(valid) > 0)).alias("grounded"))


def page_kind(drawings: Column, tables: Column, pictures: Column, texts: Column) -> Column:
    return F.when(drawings > 0, "engineering_visual").when((tables >= 1) & (pictures == 0), "table_or_list").when((pictures > 0) & (texts > 0), "mixed").when(pictures > 0, "visual").otherwise("text")


def document_kind(pages: Column, drawn: Column, tabled: Column, seen: Column) -> Column:
    """By shares of its pages: drawings (a tenth), tables (a quarter), pictures (35 in a hundred), at least three pages each."""
    least = lambda share: F.greatest(F.lit(3.0), pages * share)
    return F.when(drawn >= least(0.10), "mixed_technical_manual").when(tabled >= least(0.25), "table_heavy_document").when(seen >= least(0.35), "visual_document").otherwise("text_document")
