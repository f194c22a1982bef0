"""Runtime transport evidence (S15): reports of observations and OTLP spans, checked, normalised, and joined by parent span.

Reports are nested JSON read with an explicit schema; spans are exploded, their attributes looked up by key (the last of equal keys holds), and each gives at most one
observation. A report counts only with the expected schema, the active revision and a fresh date; what else is wrong makes it partial.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_ATTRIBUTE = "struct<key: string, value: string>"
_SPAN = f"struct<traceId: string, spanId: string, parentSpanId: string, name: string, kind: string, startTimeUnixNano: string, attributes: array<{_ATTRIBUTE}>>"
_SCOPES = f"array<struct<spans: array<{_SPAN}>>>"
_RESOURCES = f"array<struct<scopeSpans: {_SCOPES}, instrumentationLibrarySpans: {_SCOPES}>>"
_OBSERVATION = "struct<transport: string, side: string, name: string, operation: string, service: string, kind: string, file: string, line: string, observedCount: string, detector: string>"
REPORT = f"schema string, repositoryRevision string, generatedAt string, coverage map<string, string>, observations array<{_OBSERVATION}>, resourceSpans {_RESOURCES}, otlp struct<resourceSpans: {_RESOURCES}>"
TRANSPORTS = ["graphql", "grpc", "event"]
_FIELDS = ["transport", "side", "name", "operation", "service", "kind", "file", "line", "observedCount", "detector"]


def _text(c: Column, most: int = 256) -> Column:
    return F.substring(F.trim(F.coalesce(c, F.lit(""))), 1, most)


def _filled(c: Column) -> Column:
    """The text, or null where it is empty."""
    t = _text(c)
    return F.when(t != "", t)


def attribute(attributes: Column, *keys: str) -> Column:
    """The value of the first key that is there, as text, whichever of the four kinds of value it has."""

    def one(key: str) -> Column:
        own = F.filter(attributes, lambda a: a["key"] == key)
        v = F.when(F.size(own) > 0, F.element_at(own, -1)["value"])
        inner = [F.get_json_object(v, f"$.{k}") for k in ("stringValue", "intValue", "doubleValue", "boolValue")]
        return F.coalesce(*inner, F.when(~v.startswith("{") & ~v.startswith("["), v))

    return F.coalesce(*[one(k) for k in keys])


def safe_file(raw: Column) -> Column:
    """A path inside the repository; null for absolute paths and those that lead out of it."""
    p = F.translate(_text(raw, 1024), "\\", "/")
    out = (p == "") | p.contains("\x00") | p.startswith("/") | p.rlike("^[A-Za-z]:") | p.startswith("../") | p.contains("/../")
    return F.when(~out, F.regexp_replace(p, r"^\./", ""))


def parsed(reports: DataFrame) -> DataFrame:
    """id, r: the reports (id, text) as structs, null where the text is no object."""
    return reports.select("id", F.from_json("text", REPORT).alias("r"))


def spans(reports: DataFrame) -> DataFrame:
    """id, trace, span, parent and the observation of every span of the reports (id, text), null where a span says nothing of a transport."""
    resources = F.coalesce("r.otlp.resourceSpans", "r.resourceSpans")
    scopes = F.explode(resources)
    rows = parsed(reports).select("id", scopes.alias("res")).select("id", F.explode(F.coalesce("res.scopeSpans", "res.instrumentationLibrarySpans")).alias("scope"))
    return observed_spans(rows.select("id", F.explode("scope.spans").alias("s")))


def observed_spans(rows: DataFrame) -> DataFrame:
    """The same for rows (id, s: span struct, more columns), a table or a stream."""
    a = F.col("s.attributes")
    system = F.lower(_text(attribute(a, "rpc.system")))
    operation, field = F.upper(_text(attribute(a, "graphql.operation.type"))), _text(attribute(a, "graphql.field.name", "graphql.field"))
    messaging, destination = _text(attribute(a, "messaging.system")), _text(attribute(a, "messaging.destination.name", "messaging.destination"))
    transport = F.when(system == "grpc", "grpc").when((operation != "") | (field != ""), "graphql").when((messaging != "") | (destination != ""), "event")
    kind, number = F.upper(F.coalesce("s.kind", F.lit(""))), F.expr("try_cast(s.kind as double)")
    event = F.col("transport") == "event"
    side = F.when(event & (kind.contains("PRODUCER") | (number == 4)), "publisher").when(event & (kind.contains("CONSUMER") | (number == 5)), "subscriber")
    side = side.when(kind.contains("SERVER") | (number == 2), "server").when(kind.contains("CLIENT") | (number == 3), "client").otherwise("")
    parts = F.filter(F.split(_text(F.col("s.name")), "/"), lambda p: p != "")
    last = F.try_element_at(parts, F.lit(-1))
    before = F.try_element_at(parts, F.lit(-2))
    grpc = F.col("transport") == "grpc"
    name = F.when(grpc, F.coalesce(_filled(attribute(a, "rpc.method")), last)).when(event, destination).otherwise(field)
    out = rows.withColumn("transport", transport).withColumns({
        "trace": F.col("s.traceId"), "span": F.col("s.spanId"), "parent": F.col("s.parentSpanId"), "side": side, "name": name, "operation": F.when(F.col("transport") == "graphql", operation),
        "service": F.when(grpc, F.coalesce(_filled(attribute(a, "rpc.service")), before)), "kind": F.when(event, _text(attribute(a, "messaging.operation.type", "messaging.operation"))),
        "file": attribute(a, "code.file.path", "code.filepath"), "line": attribute(a, "code.line.number", "code.lineno"), "observedCount": F.lit("1"), "detector": F.lit("otlp-span"),
    })
    return out.drop("s")


def normalised(rows: DataFrame) -> DataFrame:
    """Rows with the fields of an observation, cleaned, and `valid`: a known transport, side and (graphql) operation, and a name."""
    number = F.expr("try_cast(observedCount as double)")
    line = F.floor(F.expr("try_cast(line as double)"))
    rows = rows.withColumns({
        "transport": F.lower(_text(F.col("transport"))), "side": F.lower(_text(F.col("side"))), "name": _filled(F.col("name")), "operation": F.nullif(F.upper(_text(F.col("operation"))), F.lit("")), "service": _filled(F.col("service")), "kind": _filled(F.col("kind")),
        "file": safe_file(F.col("file")), "line": F.when((line > 0) & (line <= 10_000_000), line), "n": F.greatest(F.lit(1), F.least(F.lit(1_000_000_000), F.floor(F.coalesce(number, F.lit(1))))).cast("long"), "detector": F.coalesce(_filled(F.col("detector")), F.lit("runtime-report")),
    })
    sides = F.when(F.col("transport") == "event", F.col("side").isin("publisher", "subscriber")).otherwise(F.col("side").isin("server", "client", "server-call"))
    valid = F.col("transport").isin(*TRANSPORTS) & F.col("name").isNotNull() & sides & ((F.col("transport") != "graphql") | F.coalesce(F.col("operation").isin("QUERY", "MUTATION", "SUBSCRIPTION"), F.lit(False)))
    return rows.drop("observedCount").withColumn("valid", F.coalesce(valid, F.lit(False)))


def report_states(reports: DataFrame, revisions: DataFrame, schema: str, now: str, max_age_hours: int = 168) -> DataFrame:
    """id, usable, checks: what is wrong with each report (schema, revision, date, stale, <transport>-<coverage>), by its own text alone. revisions: id, revision.

    Text that is no JSON object is `invalid-json`. Dates are ISO 8601; five minutes of the future are allowed.
    """
    at = F.expr("try_to_timestamp(r.generatedAt)")
    time = F.lit(now).cast("timestamp")
    r = parsed(reports).join(revisions, "id", "left")
    age = F.unix_micros(time) - F.unix_micros("at")
    stale = (age < -300_000_000) | (age > max(1, min(8760, max_age_hours)) * 3_600_000_000)
    wrong = [F.when(F.col("r").isNull(), "invalid-json"), F.when(~F.coalesce(F.col("r.schema") == schema, F.lit(False)), "schema"), F.when(~F.coalesce(F.col("r.repositoryRevision") == F.col("revision"), F.lit(False)), "revision"), F.when(F.col("at").isNull(), "date").when(stale, "stale")]
    seen = {t: F.upper(F.coalesce(F.try_element_at("r.coverage", F.lit(t)), F.lit("NOT_CHECKED"))) for t in TRANSPORTS}
    partial = [F.when(c != "COMPLETE", F.concat(F.lit(f"{t}-"), F.lower(c))) for t, c in seen.items()]
    r = r.withColumn("at", at).withColumn("wrong", F.array_compact(F.array(*wrong)))
    return r.select("id", (F.size("wrong") == 0).alias("usable"), F.concat("wrong", F.array_compact(F.array(*partial))).alias("checks"))


def evidence(reports: DataFrame, revisions: DataFrame, schema: str, now: str, max_age_hours: int = 168) -> tuple[DataFrame, DataFrame]:
    """(observations, states) of reports (id, text).

    observations: id, transport, side, name, operation, service, kind, file, line, n, detector, of usable reports. states: id, status (complete or
    partial), reasons, observed, ignored. Every observation and span is read; a limit is the caller's.
    """
    own = parsed(reports).select("id", F.explode("r.observations").alias("o")).select("id", *[F.col(f"o.{f}").alias(f) for f in _FIELDS])
    every = normalised(own.unionByName(spans(reports).where("transport is not null").select("id", *_FIELDS)))
    states = report_states(reports, revisions, schema, now, max_age_hours)
    fine = states.where("usable").select("id")
    kept = every.where("valid").join(fine, "id", "left_semi").drop("valid")
    counts = every.groupBy("id").agg(F.count("*").alias("raw"), F.sum(F.col("valid").cast("long")).alias("good"))
    done = states.join(counts, "id", "left")
    observed = F.when(F.col("usable"), F.coalesce("good", F.lit(0))).otherwise(0).cast("long")
    done = done.withColumn("observed", observed).withColumn("ignored", F.coalesce("raw", F.lit(0)) - F.col("observed"))
    reasons = F.concat("checks", F.when(F.col("ignored") > 0, F.array(F.lit("ignored"))).otherwise(F.array().cast("array<string>")))
    return kept, done.select("id", F.when(F.size(reasons) > 0, "partial").otherwise("complete").alias("status"), F.array_join(reasons, ",").alias("reasons"), "observed", "ignored")


def span_calls(found: DataFrame) -> DataFrame:
    """transport, service, name, client_file, server_file, n: client spans with the server spans directly under them, of one trace. found: as `spans` gives them.

    An equi-join on (id, trace, span); spans without trace or span id have no children, and a server span has one parent, so rows don't multiply but by repeated span ids.
    """
    s = normalised(found.where("transport in ('grpc', 'graphql')")).where("valid")
    up = s.where("side = 'client'").select("id", "trace", F.col("span").alias("parent"), "transport", F.col("file").alias("client_file"))
    down = s.where("side = 'server'").select("id", "trace", "parent", "transport", "service", "name", F.col("file").alias("server_file"))
    return up.join(down, ["id", "trace", "parent", "transport"]).groupBy("transport", "service", "name", "client_file", "server_file").agg(F.count("*").alias("n"))


def activity(stream: DataFrame, width: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """window, transport, side, name, n of a stream (or table) of (id, at, s: span struct): a span counts once, late ones within `delay`.

    Repeated spans are dropped within the watermark, so state stays bounded by the delay.
    """
    rows = observed_spans(stream.withWatermark("at", delay)).where("transport is not null")
    once = rows.dropDuplicatesWithinWatermark(["id", "trace", "span"]) if stream.isStreaming else rows.dropDuplicates(["id", "trace", "span"])
    fine = normalised(once).where("valid")
    return fine.groupBy(F.window("at", width), "transport", "side", "name").agg(F.sum("n").alias("n"))
