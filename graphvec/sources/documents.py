"""Document ingestion: text, CSV, JSON and HTML to points, with a deterministic hashing embedder where no model is given."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .payload import encode

TAG = r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]+>"


def read(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """source, text of the files at `path`: whole text or HTML files, rows of CSV (header, all columns joined), JSON lines."""
    if kind in ("text", "html"):
        rows = spark.read.option("wholetext", True).text(path).select(F.input_file_name().alias("source"), F.col("value").alias("text"))
        return rows if kind == "text" else rows.withColumn("text", strip_html("text"))
    if kind == "csv":
        rows = spark.read.option("header", True).csv(path)
        return rows.select(F.input_file_name().alias("source"), F.concat_ws("\n", *[F.concat(F.lit(f"{c}: "), F.col(c)) for c in rows.columns]).alias("text"))
    if kind == "json":
        rows = spark.read.json(path)
        return rows.select(F.input_file_name().alias("source"), F.to_json(F.struct(*rows.columns)).alias("text"))
    raise ValueError(f"unknown kind {kind!r}")


def strip_html(text: Column | str) -> Column:
    text = F.col(text) if isinstance(text, str) else text
    plain = F.regexp_replace(text, TAG, " ")
    for mark, sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        plain = F.replace(plain, F.lit(mark), F.lit(sign))
    return F.trim(F.regexp_replace(plain, r"\s+", " "))


def split(docs: DataFrame, size: int = 500, overlap: int = 50) -> DataFrame:
    """A row for each piece of at most `size` characters, `overlap` of them shared with the one before."""
    if not 0 <= overlap < size:
        raise ValueError("overlap must be less than size")
    starts = F.sequence(F.lit(0), F.greatest(F.length("text") - overlap - 1, F.lit(0)), F.lit(size - overlap))
    return docs.withColumn("start", F.explode(starts)).withColumn("text", F.substring(F.col("text"), F.col("start") + 1, F.lit(size)))


def hashed_embedding(text: Column | str, size: int) -> Column:
    """A unit vector of hashed word counts: no model, equal words near each other."""
    text = F.col(text) if isinstance(text, str) else text
    places = F.transform(F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != ""), lambda w: F.pmod(F.xxhash64(w), F.lit(size)).cast("int"))
    counts = F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.size(F.filter(places, lambda p: p == i)).cast("double"))
    norm = F.sqrt(F.aggregate(counts, F.lit(0.0), lambda a, x: a + x * x))
    return F.transform(counts, lambda x: F.when(norm > 0, x / norm).otherwise(F.lit(0.0)).cast("float"))


def to_points(docs: DataFrame, size: int, embed: Callable[[Column], Column] | None = None) -> DataFrame:
    """id, vector, labels, payload of documents (source, text): ready for an upsert. `embed` may be a pandas UDF."""
    vector = embed(F.col("text")) if embed else hashed_embedding("text", size)
    return docs.select(F.xxhash64("source", "text").alias("id"), vector.alias("vector"), F.array(F.lit("Document")).alias("labels"), encode(text=F.col("text")).alias("payload"))
