"""What a repository is made of: backing services by evidence (A34), components by folders (G21), seeds of a question."""

from __future__ import annotations

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.operators.rules import top_per

# Backing services.

#: What must follow a generic prefix of an environment variable, and packages that stand for a service in tests.
ENV_SUFFIX = r"_(HOSTS?|URLS?|URI|DSN|PORTS?|ADDR|ADDRESS(ES)?|BROKERS?|SERVERS?|ENDPOINTS?|CONN|CONNECTION(S)?|DB|DATABASE|PASS(WORD)?|USER(NAME)?|SECRET|TOPICS?|BUCKETS?|REGION|GROUP|CLUSTER|NAMESPACE|REPLICA(SET)?|MEASUREMENT|TLS|SSL|KEY|TOKEN)$"
TEST_DOUBLE = r"(?i)(-mock|_mock|mock-|fake|memory-server|inmemory|testcontainers|-local$|localstack|azurite)"


def _heads(value: Column, marks: str) -> Column:
    """The value, and each of its beginnings that ends before one of the marks."""
    ends = F.filter(F.sequence(F.lit(1), F.greatest(F.length(value), F.lit(1))), lambda i: F.contains(F.lit(marks), F.substring(value, i, 1)) & (F.substring(value, i, 1) != ""))
    return F.array_distinct(F.concat(F.array(value), F.transform(ends, lambda i: F.substring(value, 1, i - 1))))


def image_repository(ref: Column) -> Column:
    """An image reference without quotes, digest and tag, in lower case."""
    plain = F.regexp_replace(F.regexp_replace(F.trim(ref), "^['\"]|['\"]$", ""), "@.*$", "")
    return F.lower(F.regexp_replace(plain, ":[^/]*$", ""))


def service_signals(evidence: DataFrame, registry: DataFrame) -> DataFrame:
    """repo, service, source (manifest, image, env), token: each token that some evidence of the repository bears out.

    evidence: repo, kind (dep, image, env), value; registry: service, kind (dep, image, env, env-weak, import), token, a table of fixed size. A dependency equals its token or
    goes on with / : or @; an image's path ends with the token's parts; a variable equals its token or goes on with _, and a weak token needs an ending that names a
    connection. Each value is exploded into the few tokens it could bear out, which meet the registry by equality.
    """
    dep = evidence.where("kind = 'dep'").where(~F.col("value").rlike(TEST_DOUBLE)).select("repo", F.lit("dep").alias("kind"), F.explode(_heads(F.lower(F.trim("value")), "/:@")).alias("token"), F.lit("").alias("rest"))
    parts = F.filter(F.split(image_repository(F.col("value")), "/"), lambda p: p != "")
    tails = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts), F.lit(1))), lambda i: F.array_join(F.slice(parts, i, F.greatest(F.size(parts), F.lit(1))), "/"))
    image = evidence.where("kind = 'image'").select("repo", F.lit("image").alias("kind"), F.explode(tails).alias("token"), F.lit("").alias("rest"))
    name = F.upper("value")
    env = evidence.where("kind = 'env'").select("repo", F.lit("env").alias("kind"), name.alias("name"), F.explode(_heads(name, "_")).alias("token"))
    env = env.select("repo", "kind", "token", F.expr("substring(name, length(token) + 1)").alias("rest"))
    own = registry.withColumn("weak", F.col("kind") == "env-weak").withColumn("kind", F.regexp_replace("kind", "-weak$", ""))
    own = own.withColumn("token", F.when(F.col("kind") == "env", F.upper("token")).when(F.col("kind") == "image", F.array_join(F.filter(F.split(F.lower("token"), "/"), lambda p: p != ""), "/")).otherwise(F.lower("token")))
    met = dep.unionByName(image).unionByName(env).where("token <> ''").join(F.broadcast(own.where("kind <> 'import'")), ["kind", "token"])
    met = met.where(~F.col("weak") | F.col("rest").rlike(ENV_SUFFIX))
    return met.select("repo", "service", F.when(F.col("kind") == "dep", "manifest").otherwise(F.col("kind")).alias("source"), "token").distinct()


def service_files(files: DataFrame, registry: DataFrame) -> DataFrame:
    """repo, file, service, token: files (repo, file, text) that name an import token in quotes or as a path. One automaton over all tokens reads each text once."""
    tokens = [(r.service, r.token.lower()) for r in registry.where("kind = 'import'").select("service", "token").distinct().collect()]  # the registry is a parameter
    if not tokens:
        return files.select("repo", "file", F.lit(None).cast("string").alias("service"), F.lit(None).cast("string").alias("token")).limit(0)

    def run(batches):
        trie: dict[str, set[int]] = {}
        for k, (_, t) in enumerate(tokens):
            for form in (f'"{t}', f"'{t}", f"`{t}", f'/{t}"', f"{t}/"):
                trie.setdefault(form, set()).add(k)
        automaton = ahocorasick.Automaton()
        for form, ks in trie.items():
            automaton.add_word(form, ks)
        automaton.make_automaton()
        for batch in batches:
            row, service, token = [], [], []
            for i, text in enumerate(batch.column("text").to_pylist()):
                for k in sorted(set().union(*(ks for _, ks in automaton.iter((text or "").lower())))):
                    row.append(i)
                    service.append(tokens[k][0])
                    token.append(tokens[k][1])
            take = pa.array(row, pa.int64())
            yield pa.record_batch([batch.column("repo").take(take), batch.column("file").take(take), pa.array(service, pa.string()), pa.array(token, pa.string())], names=["repo", "file", "service", "token"])

    kinds = {f.name: f.dataType.simpleString() for f in files.schema.fields}
    return files.select("repo", "file", "text").mapInArrow(run, f"repo {kinds['repo']}, file {kinds['file']}, service string, token string")


def backing_services(evidence: DataFrame, files: DataFrame, registry: DataFrame) -> DataFrame:
    """repo, service, sources, signals, files, confidence.

    high: a dependency or an image, or a variable and an import; medium: one of the latter. signals counts the tokens borne out outside of source text.
    """
    told = service_signals(evidence, registry).groupBy("repo", "service").agg(F.collect_set("source").alias("told"), F.count("*").alias("signals"))
    named = service_files(files, registry).groupBy("repo", "service").agg(F.count_distinct("file").alias("files"))
    both = told.join(named, ["repo", "service"], "full_outer")
    sources = F.array_sort(F.concat(F.coalesce("told", F.array().cast("array<string>")), F.when(F.col("files").isNotNull(), F.array(F.lit("import"))).otherwise(F.array().cast("array<string>"))))
    hard = F.array_contains("sources", "manifest") | F.array_contains("sources", "image") | (F.array_contains("sources", "env") & F.array_contains("sources", "import"))
    out = both.withColumn("sources", sources)
    return out.select("repo", "service", F.array_join("sources", ",").alias("sources"), F.coalesce("signals", F.lit(0)).cast("long").alias("signals"), F.coalesce("files", F.lit(0)).cast("long").alias("files"), F.when(hard, "high").otherwise("medium").alias("confidence"))


# Components.

#: Folders of sources, and the most files of a Java component before it is split.
SOURCE_ROOTS = ["src", "app", "lib", "packages", "services"]
MOST_FILES = 80


def territories(files: DataFrame, most: int = MOST_FILES) -> DataFrame:
    """file, key, name, path of the component each file lies in.

    A Java source tree is cut under the folders that all its files share, and a part of more than `most` files with two or more folders again, until none is left to cut.
    Whether a folder is cut depends on what lies under it alone, so all folders are counted once, by partial sums over exploded prefixes, and every file
    looks for the first folder on its way that is not cut. Other files take <dir>/src/<dir>, a source root's folder, or their top folder.
    """
    file = files.select("file").where("file is not null").distinct()
    root = F.concat(F.regexp_extract("file", r"(?i)^(.*?)(?:/)?src/main/java/(.+\.java)$", 1), F.lit("/"))
    is_java = F.col("file").rlike(r"(?i)^(.*?)(?:/)?src/main/java/(.+\.java)$")
    tail = F.split(F.regexp_extract("file", r"(?i)^(.*?)(?:/)?src/main/java/(.+\.java)$", 2), "/")
    java = file.where(is_java).select("file", F.concat(F.when(root != "/", root).otherwise(""), F.lit("src/main/java")).alias("root"), F.slice(tail, 1, F.greatest(F.size(tail) - 1, F.lit(0))).alias("dirs"))
    sizes = java.groupBy("root").agg(F.count("*").alias("n"), F.min(F.size("dirs")).alias("shortest"))
    at = java.select("root", F.posexplode("dirs").alias("level", "dir")).groupBy("root", "level").agg(F.count("*").alias("m"), F.min("dir").alias("a"), F.max("dir").alias("b"))
    shared = at.join(sizes, "root").where("m = n and a = b").groupBy("root").agg(F.collect_set("level").alias("levels"))  # no more levels than the shortest path has
    first_gap = F.array_min(F.array_except(F.sequence(F.lit(0), F.col("shortest")), F.coalesce("levels", F.array().cast("array<int>"))))
    common = sizes.join(shared, "root", "left").select("root", F.least(first_gap, F.greatest(F.col("shortest") - 1, F.lit(0))).alias("common"))
    java = java.join(common, "root")
    # Every folder of a file from its first territory down: the folder, and whether the file lies in a folder below.
    steps = F.when(F.size("dirs") > F.col("common"), F.sequence(F.col("common") + 1, F.size("dirs"))).otherwise(F.array().cast("array<int>"))
    folder = lambda n: F.concat_ws("/", "root", F.array_join(F.slice("dirs", 1, n), "/"))
    way = java.select("file", "root", "dirs", F.explode_outer(steps).alias("n")).select("file", folder(F.col("n")).alias("base"), "n", F.try_element_at("dirs", F.col("n") + 1).alias("child"))
    held = way.where("n is not null").groupBy("base", "child").agg(F.count("*").alias("m")).groupBy("base").agg(F.sum("m").alias("m"), F.count("child").alias("folders"))
    cut = held.where((F.col("m") > most) & (F.col("folders") >= 2)).select("base", F.lit(True).alias("cut"))
    stop = way.join(cut, "base", "left").where("n is not null and (cut is null or child is null)").groupBy("file").agg(F.min_by(F.struct("base", F.coalesce("cut", F.lit(False)).alias("root_file")), "n").alias("s"))
    java = file.where(is_java).join(stop, "file", "left")
    loose = F.coalesce("s.root_file", F.lit(False))
    base = F.coalesce("s.base", "file")
    java = java.select("file", F.when(loose, F.concat(base, F.lit("::root"))).otherwise(base).alias("key"), F.when(loose, F.concat(base, F.lit(" (root files)"))).otherwise(base).alias("name"), F.when(loose, F.col("file")).otherwise(base).alias("path"))

    nested = r"^(.*?)/src/(.+)$"
    above, below = F.regexp_extract("file", nested, 1), F.split(F.regexp_extract("file", nested, 2), "/")
    is_nested = F.col("file").rlike(nested) & (above != "") & ~((below[0] == "main") & F.coalesce(F.get(below, F.lit(1)) == "java", F.lit(False)))
    inner = F.when(F.size(below) > 1, F.concat(above, F.lit("/src/"), below[0])).otherwise(F.col("file"))
    parts = F.filter(F.split("file", "/"), lambda p: p != "")
    rooted = F.array_contains(F.array(*map(F.lit, SOURCE_ROOTS)), F.get(parts, F.lit(0)))
    top = F.array_join(F.slice(parts, 1, F.when(rooted, 2).otherwise(1)), "/")
    one, two = F.size(parts) <= 1, rooted & (F.size(parts) == 2)
    key = F.when(is_nested, inner).when(one, "root-code").when(two, F.concat(F.get(parts, F.lit(0)), F.lit("-root"))).otherwise(top)
    name = F.when(is_nested, inner).when(one, "root code").when(two, F.concat(F.get(parts, F.lit(0)), F.lit(" (root files)"))).otherwise(top)
    path = F.when(is_nested, inner).when(one | two, F.col("file")).otherwise(top)
    return java.unionByName(file.where(~is_java).select("file", key.alias("key"), name.alias("name"), path.alias("path")))


def components(found: DataFrame, top: int | None = 200) -> DataFrame:
    """key, name, n_files: the largest components first, by key among equals; `top` as the report shows, None for all."""
    sums = found.groupBy("key").agg(F.min("name").alias("name"), F.count("*").alias("n_files"))
    return sums if top is None else sums.orderBy(F.desc("n_files"), "key").limit(top)


# Seeds.

#: Points of a match, for a concept's own word and for its other words; endings of data and prose.
EXACT, SEGMENT, WORD, PART = (60, 42), (48, 36), (36, 25), (12, 7)
DATA_OR_PROSE = r"(?i)\.(?:json|ya?ml|toml|ini|md|mdx|rst|adoc|html?|css|scss|less|svg)$"


def _words(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.regexp_replace(text, "([a-z0-9])([A-Z])", "$1 $2")), "[^a-z0-9_]+"), lambda w: w != "")


def seed_scores(nodes: DataFrame, concepts: list[list[str]], structural: bool = False) -> DataFrame:
    """concept, id, score (R15) of nodes that fit a concept at all. nodes: id, label, file, is_symbol, degree; concepts: each its own word, then like ones.

    Best of: the label or its stem is the word; a part of the path is; a word of id, label or file is; id or label hold it (4 letters or more). Then 7 for a file, up
    to 3 for a short path, up to 2 for degree. structural: the question is about the program's start or tools, for which data, prose, symbols, scripts and
    static files lose points. One narrow pass, no shuffle.
    """
    file = F.regexp_replace(F.lower(F.translate(F.coalesce("file", F.substring_index("id", "#", 1)), "\\", "/")), r"^\./", "")
    label, ident = F.lower(F.coalesce("label", F.lit(""))), F.lower(F.translate("id", "\\", "/"))
    stem = F.regexp_replace(F.substring_index(label, "/", -1), r"\.[^.]+$", "")
    ready = nodes.select(
        "id", "is_symbol", "degree", file.alias("file"), label.alias("label"), ident.alias("low"), stem.alias("stem"), _words(F.concat_ws(" ", "id", "label", "file")).alias("words"),
        F.flatten(F.transform(F.split(file, "/"), lambda p: _words(F.regexp_replace(p, r"\.[^.]+$", "")))).alias("segments"),
    )

    def match(term: str, k: int) -> Column:
        out = F.when((F.col("label") == term) | (F.col("stem") == term), EXACT[k]).when(F.array_contains("segments", term), SEGMENT[k]).when(F.array_contains("words", term), WORD[k])
        return out.when(F.col("low").contains(term) | F.col("label").contains(term), PART[k]).otherwise(0) if len(term) >= 4 and term not in ("tool", "tools") else out.otherwise(0)

    depth = F.when(F.col("file") == "", 9).otherwise(F.size(F.split("file", "/")))
    more = F.when(F.col("is_symbol"), 0).otherwise(7) + F.greatest(F.lit(0), 4 - depth) + F.least(F.lit(2.0), F.col("degree") / 40)
    if structural:
        lost = F.when(F.col("file").rlike(DATA_OR_PROSE), 34).otherwise(0) + F.when(F.col("is_symbol"), 18).otherwise(0)
        more = more - lost - F.when(F.col("file").rlike("^(?:scripts?|tools?/scripts?)/"), 32).otherwise(0) - F.when(F.col("file").rlike("^(?:site|website|public|static|assets)/"), 28).otherwise(0)
    each = []
    for c, terms in enumerate(concepts):
        best = F.greatest(*[match(t, min(1, i)) for i, t in enumerate(terms)], F.lit(0))
        each.append(F.struct(F.lit(c).alias("concept"), F.when(best > 0, F.greatest(F.lit(0.0), best + more)).otherwise(0.0).alias("score")))
    return ready.select("id", F.explode(F.array(*each)).alias("s")).select("s.concept", "id", "s.score").where("score > 0")


def seeds(scores: DataFrame, concepts: int, limit: int = 8) -> DataFrame:
    """position, id (R15, W5): for each concept in turn the best node that no earlier one took; then the best by total, until there are `limit`.

    Total: the best score and a tenth of the sum. No concept needs more than its first `limit` nodes, nor the total more than its first two times `limit`, so that is all
    that comes together in one place.
    """
    best = top_per(scores, ["concept"], [F.desc("score"), "id"], limit).select("concept", "id", "score")
    total = scores.groupBy("id").agg((F.max("score") + F.sum("score") / 10).alias("score")).orderBy(F.desc("score"), "id").limit(2 * limit)
    line = best.unionByName(total.select(F.lit(concepts).alias("concept"), "id", "score"))
    turns = F.sort_array(F.collect_list(F.struct("concept", (-F.col("score")).alias("low"), "id")))
    kind = line.select(F.struct("concept", (-F.col("score")).alias("low"), "id").alias("x")).schema["x"].dataType.simpleString()
    one = line.groupBy().agg(turns.alias("line"))
    full = lambda acc, x: F.exists(acc, lambda y: (y["id"] == x["id"]) | ((y["concept"] == x["concept"]) & (x["concept"] < concepts))) | (F.size(acc) >= limit)
    taken = F.aggregate("line", F.array().cast(f"array<{kind}>"), lambda acc, x: F.when(full(acc, x), acc).otherwise(F.concat(acc, F.array(x))))
    return one.select(F.posexplode(taken).alias("position", "x")).select("position", "x.id")
