"""Secrets in texts, with weak candidates reported where their counterparts are near.

Only built-in functions. Positions come from cutting a text at its matches: the lengths of the
stretches between and of the matches add up to where each match lies.

Some parts of a credential say little alone: an account or key name, a mixed string of
32 characters or more, a URL. Each is a weak candidate. Parts of one document are joined on intervals: for every weak part
it is found whether a part of another role lies within ``reach`` code points, by the furthest
end of the parts before it and the nearest start of those after it. A long string is reported
beside a name or a URL, a name beside a secret, a URL beside both. Strong spans count as parts:
``access`` names a key, ``assign`` and ``hex`` are secrets.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowgauge.llm.common import few, written

KINDS = ["assign", "access", "hex", "name", "string", "url"]
NAMES = "[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY]"
ASSIGN = rf"""({NAMES})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS, HEX = "AKIA[A-Z0-9]+", "[0-9a-f]{24,}"
OWNERS = r"(?i:user(?:name|_id)?|login|account|client_id|access_?key(?:_?id)?|e-?mail)"
WEAK_NAME = rf"""(?<![A-Za-z0-9_]){OWNERS}["']?\x20*[:=]\x20*["']?([A-Za-z0-9@._+-]{{3,}})"""
WEAK_STRING = r"(?<![A-Za-z0-9+/])(?=[A-Za-z+/]*[0-9])(?=[a-z0-9+/]*[A-Z])(?=[A-Z0-9+/]*[a-z])[A-Za-z0-9+/]{32,}"
WEAK_URL = r"""https?://[^\x20\x09-\x0D"'<>]+"""
ROLE = {"assign": "secret", "access": "name", "hex": "secret", "name": "name", "string": "secret", "url": "url"}
REACH, CHUNK = 256, 64
MASK = "[secret]"
SPAN = "array<struct<start:long,kind:int,end:long>>"


def found(text: Column, pattern: str, kind: str, group: int = 0, least: int = 1) -> Column:
    """Spans of the leftmost matches that do not overlap; those whose ``group`` is shorter than
    ``least`` are dropped. Starts are running sums, taken in chunks so that the work stays near
    the number of matches."""
    whole, part = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    steps = F.arrays_zip(F.slice(F.split(text, pattern, -1), F.lit(1), F.size(whole)).alias("gap"), whole.alias("hit"), part.alias("part"))
    parts = F.transform(steps, lambda s: F.struct(
        F.length(s["gap"]).cast("long").alias("gap"), F.length(s["hit"]).cast("long").alias("hit"), F.length(s["part"]).alias("part")))
    total = lambda xs: F.aggregate(xs, F.lit(0).cast("long"), lambda a, s: a + s["gap"] + s["hit"])

    def spans(all_: Column) -> Column:
        chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(all_) - 1) / CHUNK).cast("int")),
                             lambda c: F.slice(all_, c * CHUNK + 1, F.lit(CHUNK)))
        bases = F.aggregate(chunks, F.array(F.lit(0).cast("long")),
                            lambda a, c: F.concat(a, F.array(F.element_at(a, -1) + total(c))))
        return F.flatten(F.zip_with(chunks, F.slice(bases, F.lit(1), F.size(chunks)), lambda c, base: F.transform(c, lambda s, i: F.struct(
            (base + total(F.slice(c, F.lit(1), i)) + s["gap"]).alias("start"), F.lit(KINDS.index(kind)).alias("kind"),
            (base + total(F.slice(c, F.lit(1), i)) + s["gap"] + s["hit"]).alias("end"), s["part"].alias("part")))))

    kept = F.transform(F.filter(spans(parts), lambda s: s["part"] >= least), lambda s: s.dropFields("part"))
    return F.when(text.rlike(pattern), kept).otherwise(F.array().cast(SPAN)).cast(SPAN)


def as_text(spans: Column) -> Column:
    """kind:start:end by start, then kind as listed."""
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(
        ":", F.element_at(kinds, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan(docs: DataFrame, reach: int = REACH) -> DataFrame:
    """(doc_id, mark, base, more): spans of every row of ``docs`` (doc_id, text, ...).

    ``mark`` is a hash of the text, by which rows are told apart; ``more`` are the linked weak
    spans that no base span covers. A null text is empty. Repeated rows, and rows without
    doc_id, each keep a row. Other columns play no part.
    """
    text = F.coalesce("text", F.lit(""))
    base = F.concat(found(text, ASSIGN, "assign", 2, 6), found(text, ACCESS, "access", 0, 20), found(text, HEX, "hex"))
    weak = F.concat(found(text, WEAK_NAME, "name"), found(text, WEAK_STRING, "string"), found(text, WEAK_URL, "url"))
    read = written(docs.select(F.col("doc_id").cast("long"), F.xxhash64(text, F.lit("mark")).alias("mark"), base.alias("base"),
                               weak.alias("weak")), "spans")
    loose = F.filter("weak", lambda w: ~F.exists("base", lambda b: (b["start"] < w["end"]) & (w["start"] < b["end"])))
    some = read.where("size(weak) > 0 and size(weak) + size(base) > 1").select("doc_id", "mark", "base", loose.alias("loose")).distinct()
    parts = some.select("doc_id", "mark", F.explode(F.concat("base", "loose")).alias("s")).select("doc_id", "mark", "s.*")
    role = F.element_at(F.array(*[F.lit(ROLE[k]) for k in KINDS]), F.col("kind") + 1)
    parts = parts.withColumn("role", role)
    along = Window.partitionBy("doc_id", "mark").orderBy("start", "end", "kind")
    before, after = along.rowsBetween(Window.unboundedPreceding, -1), along.rowsBetween(1, Window.unboundedFollowing)

    def near(name: str) -> Column:
        last = F.max(F.when(F.col("role") == name, F.col("end"))).over(before)
        following = F.min(F.when(F.col("role") == name, F.col("start"))).over(after)
        return F.coalesce(F.col("start") - last <= reach, F.lit(False)) | F.coalesce(following - F.col("end") <= reach, F.lit(False))

    parts = parts.select("*", *[near(r).alias(f"near_{r}") for r in ("name", "secret", "url")])
    kind = lambda k: F.col("kind") == KINDS.index(k)
    linked = ((kind("string") & (F.col("near_name") | F.col("near_url"))) | (kind("name") & F.col("near_secret"))
              | (kind("url") & F.col("near_name") & F.col("near_secret")))
    more = parts.where(linked).groupBy("doc_id", "mark").agg(F.collect_set(F.struct("start", "kind", "end")).alias("more"))
    more = few(written(more.select(F.col("doc_id").alias("d"), F.col("mark").alias("m"), "more"), "linked"), parts=F.size("more"))
    return read.join(more, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("mark") == F.col("m")), "left").select(
        "doc_id", "mark", "base", F.coalesce("more", F.array().cast(SPAN)).alias("more"))


def digests(docs: DataFrame, reach: int = REACH) -> DataFrame:
    """Counts of the base kinds, a digest of the base spans, and all spans, for every row."""
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == KINDS.index(k))).cast("long").alias(f"n_{k}")
    return scan(docs, reach).select(
        "doc_id", count("assign"), count("access"), count("hex"), F.sha2(as_text(F.col("base")), 256).alias("base_sha256"),
        as_text(F.concat("base", "more")).alias("spans"))


def masked(docs: DataFrame, reach: int = REACH) -> DataFrame:
    """``docs`` with every span of its texts replaced by ``MASK``, and n_chars, if there, counted
    anew; spans that overlap become one."""
    spans = scan(docs, reach).where("size(base) + size(more) > 0").select(
        F.col("doc_id").alias("__d"), F.col("mark").alias("__m"), F.array_sort(F.concat("base", "more")).alias("__spans")
    ).dropDuplicates(["__d", "__m"])
    text = F.coalesce("text", F.lit(""))
    spans = few(written(spans, "masks"), parts=F.size("__spans"))
    joined = docs.join(spans, F.col("doc_id").cast("long").eqNullSafe(F.col("__d"))
                       & (F.xxhash64(text, F.lit("mark")) == F.col("__m")), "left")
    start = F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at"))

    def step(acc: Column, s: Column) -> Column:
        gap = F.substr(F.col("text"), (acc["at"] + 1).cast("int"), F.greatest(s["start"] - acc["at"], F.lit(0)).cast("int"))
        return F.struct(F.when(s["start"] >= acc["at"], F.concat(acc["out"], gap, F.lit(MASK))).otherwise(acc["out"]).alias("out"),
                        F.greatest(acc["at"], s["end"]).alias("at"))

    new = F.aggregate("__spans", start, step, lambda acc: F.concat(acc["out"], F.substr(F.col("text"), (acc["at"] + 1).cast("int"))))
    hidden = joined.withColumn("text", F.when(F.col("__spans").isNull(), F.col("text")).otherwise(new)).drop("__d", "__m")
    if "n_chars" in docs.columns:
        hidden = hidden.withColumn("n_chars", F.when(F.col("__spans").isNull(), F.col("n_chars")).otherwise(
            F.length("text").cast(docs.schema["n_chars"].dataType)))
    return hidden.select(*docs.columns)
