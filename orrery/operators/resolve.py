"""Resolution joins: calls to scopes, transports, handlers, overlays, reports, re-exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.operators import ranges
from orrery.operators.rules import top_per
from orrery.store import Scratch

#: Fixed value: the most rows of a step that joins send to all executors.
FEW = 50_000


def scopes(calls: DataFrame, own: DataFrame, shared: DataFrame) -> DataFrame:
    """file, name, target, scope of each call: the file's symbol, else its folder's if that is one only.

    calls: file, folder, name; own: file, name, id; shared: folder, name, id.
    """
    near = own.groupBy("file", "name").agg(F.min("id").alias("near"))
    wide = shared.groupBy("folder", "name").agg(F.min("id").alias("far"), F.max("id").alias("last")).where("far = last").drop("last")
    out = calls.join(near, ["file", "name"], "left").join(wide, ["folder", "name"], "left")
    scope = F.when(F.col("near").isNotNull(), "file").when(F.col("far").isNotNull(), "folder")
    return out.select("file", "name", F.coalesce("near", "far").alias("target"), scope.alias("scope"))


def transports(clients: DataFrame, servers: DataFrame) -> DataFrame:
    """client, server, transport (J9): operation and field, service and method (or a method only one server has), opposite topics.

    Both sides: id, transport, service, method, side.
    """
    c = clients.select(F.col("id").alias("client"), "transport", "service", "method", F.col("side").alias("cs"))
    s = servers.select(F.col("id").alias("server"), "transport", "service", "method", F.col("side").alias("ss"))
    both = ["transport", "service", "method"]
    exact = c.where("transport <> 'event'").join(s, both)
    only = s.where("transport = 'grpc'").groupBy("transport", "method").agg(F.min("server").alias("server"), F.count("*").alias("n")).where("n = 1")
    loose = c.where("service is null").join(only, ["transport", "method"])
    topic = c.where("transport = 'event'").join(s.drop("service"), ["transport", "method"]).where("cs <> ss")
    keep = ["client", "server", "transport"]
    return exact.select(keep).unionByName(loose.select(keep)).unionByName(topic.select(keep))


def handlers(endpoints: DataFrame, symbols: DataFrame, imports: DataFrame, near: int = 20) -> DataFrame:
    """endpoint, handler, score, state (J10): same file 100, same folder 40, imported 35, within `near` lines of one file 20.

    endpoints: endpoint, name, file, folder, line; symbols: id, name, file, folder, line; imports: file, id. Two best ones: ambiguous.
    No endpoint meets its namesakes one by one. For each set of signals symbols are counted by what such an endpoint asks for
    (lines by dyadic intervals), so it learns how many show these signals or more. Each set has a score of its own and a larger
    set a greater one, so in the best set that any symbol shows none shows more.
    """
    kind = symbols.schema
    void = {c: F.lit(None).cast(kind[c].dataType) for c in ("file", "folder")}

    def asks(base: int, file: Column, folder: Column, here: Column, nodes: Column) -> Column:
        """The sets of signals that hold, as rows of score, file, folder, level, node. base: 0, or 35 with the importing file as `file`."""
        def key(score: int, f: Column, d: Column, held: Column, level: Column = F.lit(None).cast("int"), node: Column = F.lit(None).cast("long")) -> Column:
            return F.when(held, F.struct(F.lit(base + score).alias("score"), f.alias("file"), d.alias("folder"), level.alias("level"), node.alias("node")))

        wide = file if base else void["file"]
        both = here & folder.isNotNull()
        plain = F.array(key(0, wide, void["folder"], F.lit(True)), key(40, wide, folder, folder.isNotNull()), key(100, file, void["folder"], here), key(140, file, folder, both))
        close = F.flatten(F.transform(nodes, lambda x: F.array(key(120, file, void["folder"], here, x["level"], x["node"]), key(160, file, folder, both, x["level"], x["node"]))))
        return F.array_compact(F.concat(plain, F.coalesce(F.when(here, close), F.array())))

    s = symbols.where("name is not null").select("id", "name", F.col("file").alias("f"), "folder", "line")
    known = imports.repartition("id").distinct().join(s, "id")  # an id's repeats meet in the partition that joins it
    ends = ranges.above(F.col("line"), F.lit(max(1, (2 * near).bit_length())))
    shown = s.select("id", "name", F.explode(asks(0, F.col("f"), F.col("folder"), F.col("f").isNotNull(), ends)).alias("k"))
    bound = known.select("id", "name", F.explode(asks(35, F.col("file"), F.col("folder"), F.col("file") == F.col("f"), ends)).alias("k"))
    keys = ["name", "k.score", "k.file", "k.folder", "k.level", "k.node"]
    sums = shown.unionByName(bound).select("id", *keys).groupBy("score", "name", "file", "folder", "level", "node").agg(F.count("*").alias("n"), F.min("id").alias("id"))
    around = ranges.cover(F.col("line") - near, F.col("line") + near)
    own = F.col("file").isNotNull()
    asked = endpoints.select("endpoint", "name", F.explode(F.concat(asks(0, F.col("file"), F.col("folder"), own, around), F.when(own, asks(35, F.col("file"), F.col("folder"), own, around)).otherwise(F.array()))).alias("k")).select("endpoint", *keys)
    a, b = asked.alias("a"), sums.alias("b")
    on = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in ("score", "name")] + [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in ("file", "folder", "level", "node")]
    met = a.join(b, on).select("endpoint", "a.score", "n", "id").groupBy("endpoint", "score").agg(F.sum("n").alias("n"), F.min("id").alias("id"))
    best = met.groupBy("endpoint").agg(F.max(F.struct("score", "n", "id")).alias("b"))
    one = F.col("b.n") == 1
    return best.select("endpoint", F.when(one, F.col("b.id")).alias("handler"), F.col("b.score").alias("score"), F.when(one, "resolved").otherwise("ambiguous").alias("state"))


def name_twins(symbols: DataFrame, least: int = 2, most: int = 12) -> DataFrame:
    """name, a, b: equal lower-case names of different files, in groups of `least` to `most` members (J14). symbols: id, name, file."""
    s = symbols.withColumn("name", F.lower("name"))
    sizes = s.groupBy("name").count().where(F.col("count").between(least, most)).select("name")
    s = s.join(sizes, "name")
    return s.alias("x").join(s.alias("y"), "name").where("x.id < y.id and x.file <> y.file").select("name", F.col("x.id").alias("a"), F.col("y.id").alias("b"))


def merge_contracts(static: DataFrame, observed: DataFrame, keys: list[str]) -> DataFrame:
    """keys, n_observed, origin (J17): what was seen at run time is counted on its static contract, or appended."""
    seen = observed.groupBy(*keys).agg(F.count("*").alias("n"))
    out = static.select(*keys).distinct().withColumn("known", F.lit(True)).join(seen, keys, "full_outer")
    return out.select(*keys, F.coalesce("n", F.lit(0)).alias("n_observed"), F.when(F.col("known"), "static").otherwise("runtime").alias("origin"))


def merge_overlay(base: DataFrame, exact: DataFrame, alive: DataFrame) -> DataFrame:
    """source, target, relation, provenance (J18): exact edges take the place of equal ones or are added; ends must be alive."""
    keys = ["source", "target", "relation"]
    fine = exact.select(keys).distinct()
    for end in ("source", "target"):
        fine = fine.join(alive.select(F.col("id").alias(end)), end, "left_semi")
    rest = base.select(keys).join(fine, keys, "left_anti")
    return rest.withColumn("provenance", F.lit("INFERRED")).unionByName(fine.withColumn("provenance", F.lit("EXACT")))


def report_files(reports: DataFrame, known: DataFrame) -> DataFrame:
    """path, file (J19): the known file that equals a reported path, or the longest that is its end at a folder; null if none.

    A path's own suffixes are exploded and joined by equality.
    """
    parts = F.split("path", "/")
    ends = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))
    met = reports.select("path").distinct().select("path", F.explode(ends).alias("file")).join(known.select("file").distinct(), "file")
    best = met.groupBy("path").agg(F.max(F.struct(F.length("file").alias("n"), "file")).alias("b")).select("path", F.col("b.file").alias("file"))
    return reports.select("path").distinct().join(best, "path", "left")


def call_arguments(calls: DataFrame, most: int = 12) -> DataFrame:
    """call, position, argument, parameter (J20): zipped by position, the first `most`; the shorter side gives nulls."""
    pair = F.slice(F.arrays_zip(F.col("arguments").alias("argument"), F.col("parameters").alias("parameter")), 1, most)
    out = calls.select("call", F.posexplode(pair).alias("position", "p"))
    return out.select("call", "position", F.col("p").getField("argument").alias("argument"), F.col("p").getField("parameter").alias("parameter"))


def reexports(own: DataFrame, star: DataFrame, depth: int | None = None, bound: int = 10_000) -> DataFrame:
    """module, name, origin, state (J4, G14): names that star exports pass on, until nothing changes, or within `depth` steps if given.

    own: module, name; star: module, from. An own name shadows a star's; `default` is never passed on; several origins are
    ambiguous. Past `bound` steps it raises. A (module, name) has no origin yet, one, or several, and which ones they are
    makes no difference then: it goes on at most twice, so cycles end, and the work does not grow with the origins of a name.
    """
    spark = own.sparkSession
    scratch, keys = Scratch(spark, "reexports"), ["module", "name"]
    star = scratch.write(star.select("module", "from").distinct(), "star")
    front = scratch.write(own.select(*keys).distinct().select(*keys, F.col("module").alias("origin"), F.lit(False).alias("many"), F.lit(True).alias("settled")), "steps/0")
    steps = lambda: spark.read.schema(front.schema).option("recursiveFileLookup", "true").parquet(f"{scratch.base}/steps")
    few = lambda df, n: F.broadcast(df) if n <= FEW else df
    k, n = 0, front.count()
    while depth is None or k < depth:
        k += 1
        if k > bound:
            raise RuntimeError(f"star exports still pass names on after {bound} steps")
        passed = few(front.where("name <> 'default'").select(F.col("module").alias("from"), "name", "origin", "many"), n)
        got = passed.join(star, "from").groupBy(*keys).agg(F.min("origin").alias("origin"), (F.max("many") | (F.min("origin") < F.max("origin"))).alias("many"))
        got = scratch.write(got, f"got-{k}")
        old = steps().join(few(got.select(*keys), got.count()), keys).groupBy(*keys).agg(F.max("settled").alias("done"), F.min("origin").alias("was"))
        news = got.join(old, keys, "left").where("done is null or (not done and (many or origin <> was))")
        many = F.col("many") | F.col("done").isNotNull()
        front = scratch.write(news.select(*keys, F.when(~many, F.col("origin")).alias("origin"), many.alias("many"), many.alias("settled")), f"steps/{k}")
        scratch.drop(f"got-{k}")
        n = front.count()
        if not n:
            break
    end = steps().groupBy(*keys).agg(F.max("many").alias("many"), F.min("origin").alias("origin"))
    return end.select(*keys, F.when(~F.col("many"), F.col("origin")).alias("origin"), F.when(F.col("many"), "ambiguous").otherwise("resolved").alias("state"))


def wrappers(calls: DataFrame) -> DataFrame:
    """name, method, argument, file of helper functions that pass a URL on (F21); several signatures of one name: ambiguous, left out."""
    one = calls.groupBy("name").agg(F.countDistinct("method", "argument", "file").alias("n"), F.min(F.struct("method", "argument", "file")).alias("w"))
    return one.where("n = 1").select("name", "w.method", "w.argument", "w.file")


def artifact_owner(imports: DataFrame, artifacts: DataFrame) -> DataFrame:
    """name, artifact (J21): the artifact whose group is the longest dotted prefix of an import; two of them: none.

    imports: name; artifacts: artifact, prefix.
    """
    parts = F.split("name", r"\.")
    starts = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "."))
    met = imports.select("name").distinct().select("name", F.explode(starts).alias("prefix")).join(artifacts, "prefix")
    sums = met.groupBy("name", "prefix").agg(F.countDistinct("artifact").alias("n"), F.min("artifact").alias("artifact"))
    best = top_per(sums.withColumn("size", F.length("prefix")), ["name"], [F.desc("size")], 1)
    return imports.select("name").distinct().join(best.where("n = 1").select("name", "artifact"), "name", "left")
