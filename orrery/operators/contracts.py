"""HTTP routes of servers against calls of clients (J8): exact shapes, parameters, catch-alls, and trailing parts.

A route is a list of segments, `:param` for a parameter, `*` at the end for a catch-all (`functions.paths.route` gives the shape). A call can fit a route with other concrete
segments only where the route has parameters, so the segments at the other places are a key: for each place pattern that routes of a length have, a call gives one key, and both sides meet
by equality. Nothing is compared with everything.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Scores of a fit.
EXACT, CONCRETE, DYNAMIC, SUFFIX, LOOSE = 1.0, 0.96, 0.78, 0.72, 0.55
PARAMETER, WILD = ":param", "*"


def segments(path: Column) -> Column:
    return F.filter(F.split(F.coalesce(path, F.lit("")), "/"), lambda s: s != "")


def _key(parts: Column, places: Column) -> Column:
    return F.array_join(F.transform(places, lambda i: F.element_at(parts, i)), "/")


def match_routes(endpoints: DataFrame, calls: DataFrame) -> DataFrame:
    """call, endpoint, kind (exact, exact-dynamic, suffix), score of every fit of equal method.

    endpoints: endpoint, method (ANY and ALL fit every one), path; calls: call, method, path, dynamic (the URL keeps a part that is not known, anywhere), prefix (its start
    is not known, or a segment is known in part). A suffix fit needs two segments or more on the shorter side, and that the whole does not fit. Null paths fit nothing, nor do empty calls; repeated rows of one id count once.
    """
    e = endpoints.where("path is not null and method is not null").select("endpoint", F.upper("method").alias("method"), segments(F.col("path")).alias("e")).distinct()
    c = calls.where("path is not null and method is not null and path <> ''").select("call", F.col("method").alias("called"), segments(F.col("path")).alias("c"), F.coalesce("dynamic", F.lit(False)).alias("dynamic"), F.coalesce("prefix", F.lit(False)).alias("prefix")).distinct()
    n, m = F.size("e"), F.size("c")
    catch = F.coalesce(F.try_element_at("e", F.lit(-1)) == WILD, F.lit(False))
    lengths = lambda low, high: F.when(high >= low, F.sequence(low, high)).otherwise(F.array().cast("array<int>"))
    form = lambda role, parts, size: F.struct(F.lit(role).alias("role"), size.alias("size"), parts.alias("parts"))
    # Routes: whole; what stands before a catch-all; whole against the end of a longer call; their own ends against a shorter call.
    ends = F.transform(lengths(F.lit(2), n - 1), lambda k: form("end", F.slice(F.col("e"), n - k + 1, k), k))
    routes = F.concat(F.array(F.when(catch, form("head", F.slice("e", 1, F.greatest(n - 1, F.lit(0))), n - 1)).otherwise(form("whole", F.col("e"), n))), F.when(n >= 2, F.array(form("short", F.col("e"), n))).otherwise(F.array().cast("array<struct<role:string,size:int,parts:array<string>>>")), ends)
    routes = e.select("endpoint", "method", "e", F.explode(routes).alias("f")).select("endpoint", "method", "e", "f.role", "f.size", "f.parts")
    kept = F.when(F.coalesce(F.try_element_at("parts", F.lit(-1)) == WILD, F.lit(False)), F.size("parts") - 1).otherwise(F.size("parts"))
    places = F.filter(lengths(F.lit(1), kept), lambda i: F.element_at("parts", i) != PARAMETER)
    routes = routes.withColumn("places", places).withColumn("key", _key(F.col("parts"), F.col("places"))).drop("parts")
    patterns = routes.select("role", "size", "places").distinct()
    # Calls: whole; each beginning; each end; whole as the end of a longer route.
    heads = F.transform(lengths(F.lit(0), m), lambda k: form("head", F.slice(F.col("c"), 1, k), k))
    tails = F.transform(lengths(F.lit(2), m - 1), lambda k: form("short", F.slice(F.col("c"), m - k + 1, k), k))
    own = F.concat(F.array(form("whole", F.col("c"), m), form("end", F.col("c"), m)), heads, tails)
    asked = c.withColumn("f", F.explode(own)).select("call", "called", "c", "dynamic", "prefix", "f.role", "f.size", "f.parts").join(patterns, ["role", "size"])
    known = ~F.exists(F.transform("places", lambda i: F.element_at("parts", i)), lambda s: s.isin(PARAMETER, WILD))
    asked = asked.where(known).withColumn("key", _key(F.col("parts"), F.col("places"))).drop("parts")
    met = asked.join(routes, ["role", "size", "places", "key"]).where(F.col("method").isin("ANY", "ALL") | (F.col("method") == F.col("called")))
    whole = F.col("role").isin("whole", "head")
    concrete = F.exists(F.arrays_zip("e", "c"), lambda p: (p["e"] == PARAMETER) & (p["c"].isNull() | (p["c"] != PARAMETER)))
    score = F.when(whole & F.col("prefix"), DYNAMIC).when(whole & concrete, CONCRETE).when(whole, EXACT).when(F.col("dynamic") | F.col("prefix"), LOOSE).otherwise(SUFFIX)
    kind = F.when(whole & F.col("prefix"), "exact-dynamic").when(whole, "exact").otherwise("suffix")
    # Where the whole fits, an end says nothing more.
    best = met.where(whole | (F.size("e") != F.size("c"))).groupBy("call", "endpoint").agg(F.max(F.struct(whole.cast("int").alias("whole"), score.alias("score"), kind.alias("kind"))).alias("b"))
    return best.select("call", "endpoint", "b.kind", "b.score")
