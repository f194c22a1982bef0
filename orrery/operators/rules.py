"""Rules, scores and findings."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from orrery.functions.paths import glob_regex, module_of


def boundary(file_pairs: DataFrame, forbidden: list[tuple[str, str]]) -> DataFrame:
    """rule, from_file, to_file of pairs that a forbidden (from glob, to glob) covers."""
    hit = F.array_compact(F.array(*[F.when(F.col("from_file").rlike(glob_regex(a)) & F.col("to_file").rlike(glob_regex(b)), F.lit(f"{a} -> {b}")) for a, b in forbidden]))
    return file_pairs.select(F.explode(hit).alias("rule"), "from_file", "to_file").distinct()


def allowed_only(component_pairs: DataFrame, allowed: dict[str, list[str]]) -> DataFrame:
    """Component pairs whose source has an allow list without the target (R2)."""
    cond = F.lit(False)
    for a, targets in allowed.items():
        cond = cond | ((F.col("from_module") == a) & ~F.col("to_module").isin(a, *targets))
    return component_pairs.where(cond)


def over_budget(values: DataFrame, budgets: dict[str, float]) -> DataFrame:
    """id, budget, value of every measure above its limit."""
    hits = F.array_compact(F.array(*[F.when(F.col(c) > limit, F.struct(F.lit(c).alias("budget"), F.col(c).cast("double").alias("value"))) for c, limit in budgets.items()]))
    return values.select("id", F.explode(hits).alias("h")).select("id", "h.budget", "h.value")


def fitness(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """module, internal, boundary, cohesion, boundary_ratio from the distinct pairs of files that edges join.

    edges: source, target; nodes: id, file. The least id of a file stands for it. Pairs are made distinct where the edges of a
    target are together, so only those that lead to files of several nodes are shuffled once more; the rest go on as counts of modules.
    """
    file = W.partitionBy("file")
    n = nodes.select("id", "file").select("id", module_of(F.col("file")).alias("module"), F.min("id").over(file).alias("least"), F.max("id").over(file).alias("most"))
    src = n.select(F.col("id").alias("source"), F.col("least").alias("f"), F.col("module").alias("from_module"))
    dst = n.select(F.col("id").alias("target"), F.col("module").alias("to_module"), F.when(F.col("least") < F.col("most"), F.col("least")).alias("shared"))
    met = edges.select("source", "target").join(src, "source").drop("source").join(dst, "target").distinct()
    once = met.groupBy("from_module", "to_module", "shared", F.when(F.col("shared").isNotNull(), F.col("f")).alias("f")).agg(F.count("*").alias("n"))
    p = once.groupBy("from_module", "to_module").agg(F.sum(F.when(F.col("shared").isNull(), F.col("n")).otherwise(1)).alias("n"))
    ends = F.array(F.struct(F.col("from_module").alias("module"), (F.col("from_module") == F.col("to_module")).alias("own")), F.when(F.col("from_module") != F.col("to_module"), F.struct(F.col("to_module").alias("module"), F.lit(False).alias("own"))))
    both = p.select(F.explode(F.array_compact(ends)).alias("e"), "n")
    summed = lambda held: F.coalesce(F.sum(F.when(held, F.col("n"))), F.lit(0))
    agg = both.groupBy("e.module").agg(summed(F.col("e.own")).alias("internal"), summed(~F.col("e.own")).alias("boundary"))
    total = F.col("internal") + F.col("boundary")
    return agg.select("module", "internal", "boundary", F.round(F.col("internal") / total, 4).alias("cohesion"), F.round(F.col("boundary") / total, 4).alias("boundary_ratio"))


def hot_path_score(time: Column, memory: Column, cyclomatic: Column, calls: Column, depth: Column, fan_in: Column, fan_out: Column, covered: Column) -> Column:
    """0.72 syntax + 0.20 coupling + 0.08 lack of coverage, each clamped to 0..100."""
    def clamp(c):
        return F.greatest(F.lit(0.0), F.least(F.lit(100.0), c))
    syntax = clamp(12 * time + 5 * memory + F.least(F.lit(18.0), 10 * cyclomatic / 8) + F.least(F.lit(12.0), 6 * calls / 12) + F.least(F.lit(18.0), 5 * depth))
    coupling = clamp(20 * F.log2(1.0 + fan_in) + 10 * F.log2(1.0 + fan_out))
    return F.round(0.72 * syntax + 0.20 * coupling + 0.08 * 100 * (1 - covered), 4)


def breaches(values: DataFrame, limits: dict[str, tuple[float, float]]) -> DataFrame:
    """id, severity, breaches: warning and high limits of each measure."""
    parts = [F.when(F.col(c) >= high, F.lit(f"{c}:HIGH")).when(F.col(c) >= warn, F.lit(f"{c}:WARNING")) for c, (warn, high) in limits.items()]
    found = values.withColumn("breaches", F.array_join(F.array_compact(F.array(*parts)), ","))
    return found.where("breaches <> ''").withColumn("severity", F.when(F.col("breaches").contains(":HIGH"), "high").otherwise("medium"))


def longest_prefix(files: DataFrame, prefixes: DataFrame) -> DataFrame:
    """file and its longest owner prefix (J13), by joining each file's own folders: no theta join."""
    parts = F.split("file", "/")
    dirs = files.select("file", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.struct(k.alias("k"), F.array_join(F.slice(parts, 1, k), "/").alias("prefix")))).alias("d"))
    return dirs.select("file", "d.k", "d.prefix").join(prefixes.select("prefix").distinct(), "prefix").groupBy("file").agg(F.max(F.struct("k", "prefix"))["prefix"].alias("owner"))


def version_key(v: Column) -> Column:
    """A sortable key of a dotted version: epoch, numbers, pre-releases before the release.

    Build metadata after + is dropped; 1.2 equals 1.2.0; a numeric pre-release part sorts before a word.
    """
    plain = F.regexp_replace(F.lower(v), r"^v|\+.*$", "")
    epoch = F.coalesce(F.nullif(F.regexp_extract(plain, r"^(\d+)!", 1), F.lit("")), F.lit("0"))
    core = F.regexp_extract(F.regexp_replace(plain, r"^\d+!", ""), r"^([0-9.]*)", 1)
    pre = F.regexp_replace(F.regexp_replace(plain, r"^\d+!", ""), r"^[0-9.]*[-.]?", "")
    # A number is written with its length in front, so numbers of any length and any many of them sort as text.
    sized = lambda x: F.concat(F.lpad(F.length(F.regexp_replace(x, r"^0+(?=.)", "")).cast("string"), 4, "0"), F.lit(":"), F.regexp_replace(x, r"^0+(?=.)", ""))
    nums = F.filter(F.split(F.regexp_replace(core, r"(?:\.0*)+$|^0+(?:\.0*)*$", ""), r"\."), lambda x: x != "")
    parts = F.transform(F.split(pre, r"\."), lambda x: F.when(x.rlike("^[0-9]+$"), F.concat(F.lit("0"), sized(x))).otherwise(F.concat(F.lit("1"), x)))
    # "!" sorts before the "." of a further number, so 1.2 comes before 1.2.1.
    return F.concat(sized(epoch), F.lit("|"), F.array_join(F.transform(nums, sized), "."), F.lit("!"), F.when(pre == "", "~").otherwise(F.concat(F.lit("-"), F.array_join(parts, "."))))


def affected(packages: DataFrame, advisories: DataFrame) -> DataFrame:
    """id, ecosystem, name, version of packages inside a range: introduced <= v < fixed, or v <= last.

    A hash join on (ecosystem, name); the range is a filter above it.
    """
    p = packages.withColumn("k", version_key(F.col("version")))
    j = p.join(advisories, ["ecosystem", "name"])
    inside = (F.col("k") >= version_key(F.coalesce("introduced", F.lit("0")))) & (F.col("fixed").isNull() | (F.col("k") < version_key(F.col("fixed")))) & (F.col("last").isNull() | (F.col("k") <= version_key(F.col("last"))))
    return j.where(inside).select("id", "ecosystem", "name", "version").distinct()


def osa(a: str, b: str, most: int = 3) -> int:
    """Edits with adjacent transpositions; each place is edited once. Beyond `most`: most + 1."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    rows = [list(range(len(b) + 1))]
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            best = min(rows[-1][j] + 1, row[-1] + 1, rows[-1][j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                best = min(best, rows[-2][j - 2] + 1)
            row.append(best)
        rows.append(row)
    return min(rows[-1][-1], most + 1)


def near_names(names: DataFrame, popular: DataFrame) -> DataFrame:
    """name, popular, distance: within 1 edit, or 2 where the popular name has 8 letters or more.

    Names meet where they share what is left of them without up to two letters. Scoped names (`@scope/name`) are
    compared with scoped ones only, and names of fewer than four letters, their scope left out, with none.
    """

    def deletions(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for n in b["name"]:
                one = {n} | {n[:i] + n[i + 1 :] for i in range(len(n))}
                out += [(n, k) for k in one | {x[:i] + x[i + 1 :] for x in one for i in range(len(x))}]
            yield pd.DataFrame(out, columns=["name", "k"])

    @F.pandas_udf("int")
    def distance(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([osa(x, y) for x, y in zip(a, b, strict=True)], dtype="int32")

    own = names.select("name").distinct().mapInPandas(deletions, "name string, k string")
    other = popular.select("name").distinct().mapInPandas(deletions, "name string, k string").withColumnRenamed("name", "popular")
    pairs = own.join(other, "k").where("name <> popular and startswith(name, '@') = startswith(popular, '@')").where(F.length(F.regexp_replace("name", "^@[^/]+/", "")) >= 4).select("name", "popular").distinct().join(popular.select("name").distinct(), "name", "left_anti")
    d = pairs.withColumn("distance", distance("name", "popular"))
    return d.where((F.col("distance") <= 1) | ((F.col("distance") <= 2) & (F.length("popular") >= 8)))


def finding_id(*parts: Column) -> Column:
    return F.substring(F.sha1(F.concat_ws("|", *parts)), 1, 16)


def top_per(rows: DataFrame, key: list[str], order: list, n: int) -> DataFrame:
    return rows.withColumn("__r", F.row_number().over(W.partitionBy(*key).orderBy(*order))).where(F.col("__r") <= n).drop("__r")
