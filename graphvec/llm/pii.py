"""Personal data by rules, and information-theoretic sanitisation of what reveals it. DataFrame functions only.

Base rules find e-mail addresses, IP addresses, payment cards and phone numbers. Protected entities are each distinct value
found and each host of an address. Corpus co-occurrence then tells which other terms reveal one: for an entity c and a term t
in the REACH characters around it, P(c | t) is estimated as (n(c,t) + n(c) / N) / (n(t) + 1), shrunk to the base rate as if one
more t had stood elsewhere. The term discloses the share 1 + log2 P(c | t) / log2(N / n(c)) of the entity: its pointwise mutual
information over the entity's information (1: who reads the term knows the entity). Terms of letters that disclose DISCLOSURE
or more, seen in SUPPORT different surroundings at least (one surrounding, and its copies, is no co-occurrence), become
spans of kind `term` wherever they stand. sanitise() puts a placeholder for each span of personal data, generalises terms
to a placeholder, and removes those that disclose REMOVE or more.

n(t) and N count the terms of every whole text. Counts are pre-aggregated before each shuffle. Base rules run once, and what
they find is written. The table of disclosing terms is broadcast only if its counted rows are few enough, else it is joined by
a shuffle.

The patterns are written so that a failed match is never tried again from within the same run of characters and no group
backtracks, so long runs cost linear time and no stack; they match what the plain rules match.

Defined results: null text counts as empty, without spans; repeated rows give the same spans each; terms that several
entities reveal take the greatest share; offsets are code points, ends exclusive; extra columns are ignored (kept by
sanitise); with a null doc_id the row keeps its spans.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import documents, few, written

KINDS = ("email", "ip", "card", "phone", "term")
REACH, SUPPORT, DISCLOSURE, REMOVE = 80, 2, 0.96, 0.985
LOCAL = "[A-Za-z0-9._%+-]"
EMAIL = rf"(?:\G|(?<!{LOCAL})){LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
IP_PART = r"0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9]|)"
CARD = r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){13,18}+(?![ -]?[0-9])"
PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
SPAN = "array<struct<start:int,kind:int,end:int>>"
NOT_TERM = r"[^\p{L}]+"
LEAST_TERM = 3


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _luhn(x: Column) -> Column:
    """Whether the digits of x pass the Luhn test: from the right, each second one doubled, digits summed."""
    each = F.transform(F.split(F.reverse(_digits(x)), ""), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise((d.cast("int") * 2) % 10 + F.floor(d.cast("int") / 5).cast("int")))
    return F.aggregate(F.filter(each, lambda d: d.isNotNull()), F.lit(0), lambda a, d: a + d) % 10 == 0


def _spans(text: Column, kind: int, pattern: str, gate: Column, good) -> Column:
    """Spans of the matches of a pattern that `good` accepts. split() and regexp_extract_all() walk through the same
    matches, so their pieces add up to the offsets."""
    both = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hit"))
    kindless = f"array<struct<start:int,kind:int,end:int,hit:string>>"

    def step(a: Column, x: Column) -> Column:
        start = (a["at"] + F.length(x["gap"])).cast("int")
        end = (start + F.coalesce(F.length(x["hit"]), F.lit(0))).cast("int")
        more = F.array(F.struct(start.alias("start"), F.lit(kind).alias("kind"), end.alias("end"), x["hit"].alias("hit"))).cast(kindless)
        return F.struct(end.alias("at"), F.when(x["hit"].isNull(), a["out"]).otherwise(F.concat(a["out"], more)).alias("out"))

    empty = F.struct(F.lit(0).cast("int").alias("at"), F.array().cast(kindless).alias("out"))
    found = F.aggregate(both, empty, step, lambda a: a["out"])
    kept = F.filter(found, lambda s: good(s["hit"]))
    return F.when(gate, F.transform(kept, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))).cast(SPAN)).otherwise(F.array().cast(SPAN))


def base_spans(text: Column) -> Column:
    """array<struct<start, kind, end>> of the base rules, by start, then kind."""
    part = f"^{IP_PART}(?:\\.{IP_PART}){{3}}$"
    return F.array_sort(
        F.concat(
            _spans(text, 0, EMAIL, F.contains(text, F.lit("@")), lambda m: F.lit(True)),
            _spans(text, 1, IP, text.rlike(IP), lambda m: m.rlike(part)),
            _spans(text, 2, CARD, text.rlike(CARD), _luhn),
            _spans(text, 3, PHONE, F.contains(text, F.lit("+")), lambda m: F.length(_digits(m)).between(10, 15)),
        )
    )


def _terms(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), NOT_TERM), lambda t: F.length(t) >= LEAST_TERM)


def found_in(docs: DataFrame) -> DataFrame:
    """doc_id, mark (hash of the text), base spans and `around` (entity, surroundings) of each row of `docs`, written once."""
    text = F.col("text")

    def surroundings(s: Column) -> Column:
        # the cut words at the far ends of the surroundings are dropped
        left = F.when(s["start"] > REACH, F.regexp_replace(F.substring(text, s["start"] - REACH + 1, F.lit(REACH)), r"^\p{L}+", "")).otherwise(F.substring(text, F.lit(1), s["start"]))
        right = F.regexp_replace(F.substring(text, s["end"] + 1, F.lit(REACH)), r"(?<=.{%d})\p{L}+$" % (REACH // 2), "")
        return F.struct(F.lower(F.substring(text, s["start"] + 1, s["end"] - s["start"])).alias("value"), F.concat_ws(" | ", left, right).alias("around"))

    rows = docs.select("doc_id", F.xxhash64("text").alias("mark"), "text", base_spans(text).alias("base"))
    return written(rows.select("doc_id", "mark", "base", F.transform("base", surroundings).alias("around")), "found")


def disclosing_terms(docs: DataFrame, found: DataFrame) -> DataFrame:
    """term, disclosure: the terms that reveal an entity of `docs` (doc_id, text), with the greatest share. found: found_in(docs)."""
    values = found.filter(F.size("base") > 0).select(F.explode("around").alias("a")).select("a.*")
    host = F.concat(F.lit("@"), F.substring_index("value", "@", -1))
    entities = F.when(F.contains(F.col("value"), F.lit("@")), F.array(F.col("value"), host)).otherwise(F.array("value"))
    around = values.select(F.explode(entities).alias("entity"), "around").groupBy("entity", "around").agg(F.count("*").alias("n"))
    seen = written(around.select("entity", "n", F.xxhash64("around").alias("place"), F.array_distinct(_terms(F.col("around"))).alias("terms")), "around")
    sums = seen.groupBy("entity").agg(F.sum("n").alias("n_c"))
    pairs = seen.select("entity", "n", "place", F.explode("terms").alias("term")).groupBy("entity", "term").agg(F.sum("n").alias("n_ct"), F.count("*").alias("places")).filter(F.col("places") >= SUPPORT)
    counts = written(docs.select(F.explode(_terms(F.col("text"))).alias("term")).groupBy("term").agg(F.count("*").alias("n_t")), "terms")
    total = counts.agg(F.coalesce(F.sum("n_t"), F.lit(0)).alias("n")).first()["n"]
    joined = pairs.join(counts, "term").join(sums, "entity")
    n = F.lit(float(max(2, total)))
    likely = (F.col("n_ct") + F.col("n_c") / n) / (F.greatest("n_t", "n_ct") + 1)
    share = 1 + F.log2(likely) / F.greatest(F.log2(n / F.col("n_c")), F.lit(1e-9))
    return written(joined.select("term", share.alias("disclosure")).filter(F.col("disclosure") >= DISCLOSURE).groupBy("term").agg(F.max("disclosure").alias("disclosure")), "disclosing")


def _term_spans(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """doc_id, mark (hash of the text), more: spans of disclosing terms, with the shares, of the texts that have any."""
    marked = docs.select("doc_id", F.xxhash64("text").alias("mark"), "text")
    hits = marked.select("doc_id", "mark", F.explode(F.array_distinct(_terms(F.col("text")))).alias("term")).join(few(terms), "term")
    lists = written(hits.groupBy("doc_id", "mark").agg(F.collect_set(F.struct("term", "disclosure")).alias("terms")), "hits")
    texts = marked.join(few(lists), ["doc_id", "mark"]).select("doc_id", "mark", "terms", "text").dropDuplicates(["doc_id", "mark"])
    each = texts.select("doc_id", "mark", "text", F.explode("terms").alias("t"))
    pattern = F.concat(F.lit(r"(?iu)(?<!\p{L})"), F.col("t.term"), F.lit(r"(?!\p{L})"))
    both = F.arrays_zip(F.split(F.col("text"), pattern, -1).alias("gap"), F.regexp_extract_all(F.col("text"), pattern, F.lit(0)).alias("hit"))

    def step(a: Column, x: Column) -> Column:
        start = (a["at"] + F.length(x["gap"])).cast("int")
        end = (start + F.coalesce(F.length(x["hit"]), F.lit(0))).cast("int")
        more = F.array(F.struct(start.alias("start"), F.lit(4).alias("kind"), end.alias("end"))).cast(SPAN)
        return F.struct(end.alias("at"), F.when(x["hit"].isNull(), a["out"]).otherwise(F.concat(a["out"], more)).alias("out"))

    spans = F.aggregate(both, F.struct(F.lit(0).cast("int").alias("at"), F.array().cast(SPAN).alias("out")), step, lambda a: a["out"])
    found = each.select("doc_id", "mark", F.explode(spans).alias("s"), F.col("t.disclosure").alias("disclosure"))
    return found.groupBy("doc_id", "mark").agg(F.collect_list(F.struct("s.start", "s.kind", "s.end", "disclosure")).alias("more"))


def _joined(docs: DataFrame) -> DataFrame:
    """Each row's doc_id, mark and base spans, and those of disclosing terms outside of them."""
    rows = found_in(docs)
    more = _term_spans(docs, disclosing_terms(docs, rows))
    same = rows["doc_id"].eqNullSafe(more["doc_id"]) & (rows["mark"] == more["mark"])
    outside = F.filter(F.coalesce("more", F.array().cast("array<struct<start:int,kind:int,end:int,disclosure:double>>")), lambda m: ~F.exists("base", lambda b: (b["start"] < m["end"]) & (m["start"] < b["end"])))
    return rows.join(more, same, "left").select(rows["doc_id"], rows["mark"], "base", outside.alias("more"))


def _said(spans: Column) -> Column:
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(kinds, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, n_term, base_sha256, spans for each row."""
    found = _joined(documents(docs))
    plain = F.transform("more", lambda m: F.struct(m["start"].alias("start"), m["kind"].alias("kind"), m["end"].alias("end")))

    def count(kind: int) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{KINDS[kind]}")

    return found.select("doc_id", *map(count, range(4)), F.size("more").cast("long").alias("n_term"), F.sha2(_said(F.col("base")), 256).alias("base_sha256"), _said(F.array_sort(F.concat("base", plain))).alias("spans"))


def sanitise(docs: DataFrame) -> DataFrame:
    """`docs`, all columns, with personal data and disclosing terms replaced in `text`; n_chars, if there, is made anew.
    Columns may have any names: each row travels as one value."""
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    more = _term_spans(plain, disclosing_terms(plain, found_in(plain))).select(F.col("doc_id").alias("id"), F.col("mark").alias("m"), "more")
    labels = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    piece = "array<struct<start:int,end:int,label:string>>"
    own = docs.select(F.struct("*").alias("row"))
    text = F.coalesce(F.col("row").getField("text"), F.lit(""))
    kept = own.select("row", F.xxhash64(text).alias("mark"), base_spans(text).alias("base"))
    rows = kept.join(more, F.col("row").getField("doc_id").cast("long").eqNullSafe(F.col("id")) & (F.col("mark") == F.col("m")), "left")
    base = F.transform("base", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.element_at(labels, s["kind"] + 1).alias("label"))).cast(piece)
    extra = F.transform("more", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.when(s["disclosure"] >= REMOVE, F.lit("")).otherwise(F.lit("[TERM]")).alias("label"))).cast(piece)
    spans = F.array_sort(F.concat(base, F.coalesce(extra, F.array().cast(piece))))

    def step(a: Column, s: Column) -> Column:
        # spans that overlap what is already replaced only lengthen it
        gap = F.when(s["start"] >= a["at"], F.concat(F.substring(text, a["at"] + 1, s["start"] - a["at"]), s["label"])).otherwise(F.lit(""))
        return F.struct(F.greatest(a["at"], s["end"]).cast("int").alias("at"), F.concat(a["out"], gap).alias("out"))

    clean = F.aggregate(spans, F.struct(F.lit(0).cast("int").alias("at"), F.lit("").alias("out")), step, lambda a: F.concat(a["out"], F.substring(text, a["at"] + 1, F.length(text) + 1)))
    new = F.when((F.size("base") > 0) | F.col("more").isNotNull(), clean).otherwise(F.col("row").getField("text"))
    out = rows.select("row", new.alias("clean"))

    def column(name: str, kind: str) -> Column:
        if name == "text":
            return F.col("clean").alias(name)
        return (F.length("clean").cast(kind) if name == "n_chars" else F.col("row").getField(name)).alias(name)

    return out.select(*[column(name, kind) for name, kind in docs.dtypes])
