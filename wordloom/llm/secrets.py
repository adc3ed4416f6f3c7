"""Operator 5, secret scans with corpus-wide ownership frequency; DataFrame functions only.

Matches are placed by the lengths of what stands between them (the same pattern splits the text), so spans are
code points without leaving the JVM. Values are hashed and counted over the corpus by distinct repositories
and owners: a value that several owners or many repositories hold is a copied example; one that few hold and
that looks random is taken for live. A repository without an owner may have one of its own, so a value in
several of them is not known to be held by few, and is neither. Besides the base kinds, long random-looking runs (`generic`) are candidates; they are reported
only where ownership says that they are live. Counts are combined before they are shuffled, so a value in a
third of all texts is a few rows for each task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wordloom.llm.common import documents

#: Kind, pattern, group of the value, least length of the value.
KINDS = (
    ("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]+", 0, 24),
)
GENERIC = ("generic", r"[A-Za-z0-9+/_=-]{24,}", 0, 24)
#: What a text must hold for a kind's pattern to be worth a scan.
HINTS = {"assign": r"(?i)(?:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]", "access": r"AKIA[A-Z0-9]{16}", "hex": r"[0-9a-f]{24}", "generic": r"[A-Za-z0-9+/_=-]{24}"}


def _found(kind: str, pattern: str, group: int) -> Column:
    """(kind, nth, gap before, length, value) of each match in text; none if the hint is not there."""
    parts = F.arrays_zip(F.split("text", pattern, -1).alias("gap"), F.regexp_extract_all("text", F.lit(pattern), F.lit(0)).alias("found"), F.regexp_extract_all("text", F.lit(pattern), F.lit(group)).alias("value"))
    rows = F.transform(parts, lambda x, i: F.struct(F.lit(kind).alias("kind"), i.alias("nth"), F.length(x["gap"]).alias("gap"), F.length(x["found"]).alias("size"), x["value"].alias("value")))
    none = F.array().cast("array<struct<kind:string,nth:int,gap:int,size:int,value:string>>")
    return F.when(F.col("text").rlike(HINTS[kind]), rows).otherwise(none)


def candidates(docs: DataFrame, generic: bool) -> DataFrame:
    """doc_id, text_id, repo, owner, kind, start, end, value for every match that is long enough."""
    kinds = KINDS + ((GENERIC,) if generic else ())
    some = F.lit(False)
    for k in kinds:
        some = some | F.col("text").rlike(HINTS[k[0]])
    rows = docs.filter(some).select("doc_id", "text_id", "repo", "owner", F.explode(F.concat(*[_found(*k[:3]) for k in kinds])).alias("m"))
    rows = rows.select("doc_id", "text_id", "repo", "owner", "m.*").filter("size IS NOT NULL").distinct()  # rows of one id and text are one
    before = Window.partitionBy("doc_id", "text_id", "repo", "owner", "kind").orderBy("nth").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("end", F.sum(F.col("gap") + F.col("size")).over(before))
    least = F.create_map(*[F.lit(x) for k in kinds for x in (k[0], k[3])])
    rows = rows.filter(F.length("value") >= least[F.col("kind")])
    return rows.select("doc_id", "text_id", "repo", "owner", "kind", (F.col("end") - F.col("size")).alias("start"), "end", "value")


def _of_kind(kind: str):
    return lambda x: x["kind"] == kind


def _looks_random(value: Column) -> Column:
    """Letters and digits, and at least half as many distinct characters as an even draw of 20 would give."""
    return value.rlike("[0-9]") & value.rlike("[A-Za-z]") & (F.size(F.array_distinct(F.split(value, ""))) >= 9)


def secret_scan(docs: DataFrame, copied: int = 3, generic: bool = True, id_col: str = "doc_id", text_col: str = "text", repo_col: str = "doc_id", owner_col: str = "source", copied_repos: int = 10) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_copied, most_owners, most_repos for each row.

    n_live and n_copied count the distinct values of the spans, most_owners and most_repos are the largest counts of
    one of them.

    A value of `copied` or more owners, or of `copied_repos` or more repositories, is a copied example. Else it is
    live if it looks random and its owners, with one for each repository (without an id, each text) that names
    none, are fewer than `copied`. Null and empty texts have no spans; a null repository counts as none; rows of one id and text come out alike, those
    without an id too; an empty table gives no rows; other columns are not read.
    """
    docs = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"), docs[repo_col].cast("string").alias("repo"), docs[owner_col].cast("string").alias("owner"))
    docs = docs.withColumn("text_id", F.xxhash64("text"))
    found = candidates(docs, generic).withColumn("secret", F.sha2("value", 256))
    unowned = F.when(F.col("owner").isNull(), F.coalesce("repo", F.col("text_id").cast("string")))
    holders = found.groupBy("secret").agg(F.countDistinct("owner").alias("owners"), F.countDistinct("repo").alias("repos"), F.countDistinct(unowned).alias("unowned"))
    found = found.join(holders, "secret")
    found = found.withColumn("copied", (F.col("owners") >= copied) | (F.col("repos") >= copied_repos))
    few = F.col("owners") + F.col("unowned") < copied
    found = found.withColumn("live", ~F.col("copied") & few & _looks_random(F.col("value")))
    order = F.create_map(*[F.lit(x) for n, k in enumerate((*KINDS, GENERIC)) for x in (k[0], n)])
    span = F.struct("start", order[F.col("kind")].alias("order"), "end", "kind", "live", "copied", "secret", "owners", "repos")
    by_text = found.groupBy("doc_id", "text_id").agg(F.array_sort(F.collect_set(span)).alias("all"))  # what one text holds
    base = F.filter("all", lambda x: x["kind"] != "generic")
    by_text = by_text.withColumn("base", base)
    apart = lambda x: ~F.exists("base", lambda y: (y["start"] < x["end"]) & (x["start"] < y["end"]))
    by_text = by_text.withColumn("kept", F.filter("all", lambda x: (x["kind"] != "generic") | (x["live"] & apart(x))))
    joined = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    count = lambda c, f: F.size(F.filter(c, f)).cast("long")
    values = lambda c: F.size(F.array_distinct(F.transform(F.filter("kept", lambda x: x[c]), lambda x: x["secret"]))).cast("long")
    most = lambda c: F.array_max(F.transform("kept", lambda x: x[c])).alias(f"most_{c}")
    by_text = by_text.select(
        "doc_id", "text_id", *[count("base", _of_kind(k[0])).alias(f"n_{k[0]}") for k in KINDS],
        joined("base").alias("base_spans"), joined("kept").alias("spans"), values("live").alias("n_live"), values("copied").alias("n_copied"), most("owners"), most("repos"),
    )
    by_text = by_text.withColumnsRenamed({"doc_id": "own_id", "text_id": "own_text"})
    out = docs.select("doc_id", "text_id").join(by_text, F.col("doc_id").eqNullSafe(F.col("own_id")) & (F.col("text_id") == F.col("own_text")), "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c)
    return out.select("doc_id", zero("n_assign"), zero("n_access"), zero("n_hex"), F.sha2(F.coalesce(F.col("base_spans"), F.lit("")), 256).alias("base_sha256"), F.coalesce(F.col("spans"), F.lit("")).alias("spans"), zero("n_live"), zero("n_copied"), zero("most_owners"), zero("most_repos"))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan(documents(spark, sf_dir))
