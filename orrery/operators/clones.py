"""Winnowed fingerprints, restricted Jaccard and clone pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from orrery.operators.components import connected_components
from orrery.store import Scratch

GRAM, WINDOW, HOT = 8, 4, 120


def fingerprints(texts: DataFrame) -> DataFrame:
    """id, fp: distinct least hashes of windows of 4 consecutive 8-grams of words; the last may be of 3."""
    tokens = F.filter(F.split(F.lower(F.coalesce("text", F.lit(""))), "[^a-z0-9]+"), lambda x: x != "")
    grams = F.when(F.size("t") >= GRAM, F.transform(F.sequence(F.lit(1), F.size("t") - GRAM + 1), lambda i: F.conv(F.substring(F.md5(F.array_join(F.slice("t", i, GRAM), " ").cast("binary")), 1, 8), 16, 10).cast("long"))).otherwise(F.array().cast("array<long>"))
    wins = F.when(F.size("g") >= WINDOW - 1, F.transform(F.sequence(F.lit(1), F.size("g") - WINDOW + 2), lambda i: F.array_min(F.slice("g", i, WINDOW)))).otherwise(F.array().cast("array<long>"))
    return texts.select("id", tokens.alias("t")).select("id", grams.alias("g")).select("id", F.explode(F.array_distinct(wins)).alias("fp"))


#: Fragments under SHORT tokens need so many shared fingerprints and so much similarity.
SHORT, SHORT_SHARED, SHORT_SIMILARITY = 30, 2, 0.95


def token_counts(texts: DataFrame) -> DataFrame:
    """id, tokens: the number of words that `fingerprints` sees."""
    return texts.select("id", F.size(F.filter(F.split(F.lower(F.coalesce("text", F.lit(""))), "[^a-z0-9]+"), lambda x: x != "")).alias("tokens"))


def clone_pairs(prints: DataFrame, tokens: DataFrame | None = None, least_shared: int = 8, similarity: float = 0.5) -> DataFrame:
    """a, b, shared, similarity (integer percent): fingerprints in more than HOT fragments count nowhere.

    The limit belongs to the operator's meaning and bounds each bucket of the inverted index. tokens: id, tokens; where given, a pair with
    a fragment of under SHORT tokens is kept too if it shares SHORT_SHARED fingerprints at SHORT_SIMILARITY.
    """
    prints = Scratch(prints.sparkSession, "clones").write(prints, "prints")  # read three times
    rare = prints.groupBy("fp").agg(F.count("*").alias("n")).where((F.col("n") <= HOT))
    kept = prints.join(rare.select("fp"), "fp", "left_semi")
    size = kept.groupBy("id").agg(F.count("*").alias("n"))
    multi = kept.join(rare.where("n > 1").select("fp"), "fp", "left_semi")
    pairs = multi.withColumnRenamed("id", "a").join(multi.withColumnRenamed("id", "b"), "fp").where("a < b").groupBy("a", "b").agg(F.count("*").alias("shared"))
    j = pairs.where(F.col("shared") >= (least_shared if tokens is None else min(least_shared, SHORT_SHARED))).join(size.select(F.col("id").alias("a"), F.col("n").alias("na")), "a").join(size.select(F.col("id").alias("b"), F.col("n").alias("nb")), "b")
    sim = F.col("shared") / (F.col("na") + F.col("nb") - F.col("shared"))
    kept = (sim >= similarity) & (F.col("shared") >= least_shared)
    if tokens is not None:
        j = j.join(tokens.select(F.col("id").alias("a"), F.col("tokens").alias("ta")), "a").join(tokens.select(F.col("id").alias("b"), F.col("tokens").alias("tb")), "b")
        kept = kept | ((F.least("ta", "tb") < SHORT) & (sim >= SHORT_SIMILARITY) & (F.col("shared") >= SHORT_SHARED))
    return j.where(kept).select("a", "b", "shared", F.floor(sim * 100).cast("long").alias("similarity"))


def group_evidence(pairs: DataFrame, fragments: DataFrame, shown: int = 12) -> DataFrame:
    """component, members, tokens, strongest, weakest, first (A40): what is known of each group of linked clones.

    pairs: a, b, similarity; fragments: id, location, tokens. Fragments of one location count once, the least id;
    strongest and weakest are similarities of links, not of all pairs; first: the first `shown` locations, an array.
    """
    comps = connected_components(pairs)
    members = fragments.join(comps, "id").groupBy("component", "location").agg(F.min_by("tokens", "id").alias("tokens"))
    named = members.groupBy("component").agg(F.count("*").alias("members"), F.sum("tokens").cast("long").alias("tokens"))
    order = W.partitionBy("component").orderBy("location")
    few = members.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= shown).groupBy("component").agg(F.array_sort(F.collect_list("location")).alias("first"))
    linked = pairs.join(comps.select(F.col("id").alias("a"), "component"), "a").groupBy("component").agg(F.max("similarity").alias("strongest"), F.min("similarity").alias("weakest"))
    return named.join(linked, "component").join(few, "component").select("component", "members", "tokens", "strongest", "weakest", "first")


#: Words of several languages that stay where names are renamed.
KEYWORDS = (
    "if else for while do switch case break continue return function const let var new class extends async await try catch finally throw import from export default typeof instanceof in of delete void yield static get set this super null undefined true false "
    "def elif except lambda pass raise with as is not and or None True False func go defer chan map range struct interface type package nil err string int bool byte float64 public private protected final void long double boolean"
).split(" ")
_CODE = r"[A-Za-z_$][A-Za-z0-9_$]*|(?:0[xX][0-9A-Fa-f_]+|0[bB][01_]+|0[oO][0-7_]+|[0-9][0-9_]*(?:\.[0-9][0-9_]*)?(?:[eE][+-]?[0-9][0-9_]*)?)n?|[^\sA-Za-z0-9_]"


def code_tokens(texts: DataFrame) -> DataFrame:
    """id, strict, renamed: the tokens of code; renamed has I for every name that is no keyword. Numbers are N: and their text, as they are behaviour, not names.

    For source files, blank comments and strings first (`sources.javascript.masked`).
    """
    raw = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(_CODE), 0)
    strict = F.transform(raw, lambda t: F.when(t.rlike("^[0-9]"), F.concat(F.lit("N:"), t)).otherwise(t))
    words = F.array(*map(F.lit, sorted(set(KEYWORDS))))
    renamed = F.transform("strict", lambda t: F.when(t.rlike("^[A-Za-z_$]") & ~t.startswith("N:") & ~F.array_contains(words, t), "I").otherwise(t))
    return texts.select("id", strict.alias("strict")).select("id", "strict", renamed.alias("renamed"))


def code_fingerprints(tokens: DataFrame, form: str) -> DataFrame:
    """id, fp of a token column (`strict` or `renamed`): windows of 8-grams as in `fingerprints`, and each numeric token by itself.

    Fragments of fewer than 11 tokens have none. fp: 60 bits of an MD5.
    """
    key = lambda text: F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long")
    long = tokens.where(F.size(form) >= GRAM + WINDOW - 1).select("id", F.col(form).alias("t"))
    grams = F.transform(F.sequence(F.lit(1), F.size("t") - GRAM + 1), lambda i: key(F.array_join(F.slice("t", i, GRAM), " ")))
    wins = F.transform(F.sequence(F.lit(1), F.size("g") - WINDOW + 2), lambda i: F.array_min(F.slice("g", i, WINDOW)))
    numbers = F.transform(F.filter("t", lambda t: t.startswith("N:")), lambda t: key(F.concat(F.lit("numeric:"), t)))
    return long.select("id", "t", grams.alias("g")).select("id", F.explode(F.array_distinct(F.concat(wins, numbers))).alias("fp"))
