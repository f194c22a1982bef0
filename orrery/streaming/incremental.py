"""A maintained graph of source files (T3): small changes are extracted and linked again, everything else stays.

The graph is a folder of versions. A full build writes everything; an incremental version writes only what it replaces, with a `scope` that says which
files' facts and links it owns; a reader takes every file's rows from the last version that owns it. A version counts once its commit row is written, so a lost
driver or executor leaves the version before it. The version of a batch is kept, so a batch that a stream gives again changes nothing.

A change is incremental if the set of files is the same, at most `most_changed` files differ, none of them is a configuration or another language, none
passes names on, what they export stays, and they and the files with an edge into them are at most `most_affected`. Else the graph is built anew, and the commit says why:
no-baseline, files-changed, too-many-changed, config-changed, language, barrel-changed, exports-changed, too-many-affected.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.operators import linking
from orrery.sources import javascript

#: Files whose change may change how others resolve.
CONFIG = r"(^|/)(package(-lock)?|[jt]sconfig[^/]*)\.json$|(^|/)(vite|webpack|rollup)\.config\.[^/]+$"
_COMMIT = "version long, base long, kind string, reason string, changed long, affected long, batch long"


class SourceGraph:
    """The graph in `folder`, a path that driver and executors share."""

    def __init__(self, spark: SparkSession, folder: str, aliases: dict[str, str] | None = None, most_changed: int = 24, most_affected: int = 80):
        self.spark, self.folder, self.aliases = spark, folder.rstrip("/"), aliases
        self.most_changed, self.most_affected = most_changed, most_affected

    # Versions.

    def commits(self) -> DataFrame:
        try:
            return self.spark.read.schema(_COMMIT).parquet(f"{self.folder}/commits")
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], _COMMIT)

    def head(self):
        """The last commit, or None."""
        return self.commits().orderBy(F.desc("version")).first()

    def _versions(self) -> list[int]:
        head = self.head()
        return [r.version for r in self.commits().where((F.col("version") >= head.base) & (F.col("kind") != "none")).select("version").collect()] if head else []

    def _read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(*[f"{self.folder}/{name}/v={v}" for v in self._versions()])

    def _write(self, df: DataFrame, name: str, version: int) -> DataFrame:
        path = f"{self.folder}/{name}/v={version}"
        df.withColumn("version", F.lit(version).cast("long")).write.mode("overwrite").parquet(path)
        return self.spark.read.parquet(path).drop("version")

    def table(self, name: str) -> DataFrame:
        """facts, files (file, digest), imports or calls as of the last commit; origins of the last full build, as no incremental version changes them."""
        if name == "origins":
            return self.spark.read.parquet(f"{self.folder}/origins/v={self.head().base}").drop("version")
        rows = self._read(name)
        what = "facts" if name in ("facts", "files") else "links"
        owner = self._read("scope").where(F.col("what") == what).groupBy("file").agg(F.max("version").alias("version"))
        return rows.join(owner, ["file", "version"]).drop("version")

    def _commit(self, version: int, base: int, kind: str, reason: str, changed: int, affected: int, batch: int | None) -> None:
        row = self.spark.createDataFrame([(version, base, kind, reason, changed, affected, batch)], _COMMIT)
        row.coalesce(1).write.mode("append").parquet(f"{self.folder}/commits")

    # Building.

    def rebuild(self, files: DataFrame, reason: str = "asked", changed: int = 0, batch: int | None = None) -> None:
        """All files (file, text), extracted and linked."""
        head = self.head()
        version = head.version + 1 if head else 0
        facts = self._write(javascript.facts(files.where(javascript.is_javascript(F.col("file")))), "facts", version)
        known = self._write(files.select("file", F.sha2("text", 256).alias("digest")), "files", version)
        found = self._write(linking.modules(linking.specs_of(facts), known.select("file"), self.aliases), "modules", version)
        bound = self._write(linking.bindings_of(facts, found), "bindings", version)
        source = self._write(linking.origins(linking.exports_of(facts, found), bound.withColumnRenamed("file", "module")), "origins", version)
        self._write(linking.file_imports(facts, found), "imports", version)
        self._write(linking.link_calls(facts, bound, source, linking.symbols_of(facts)), "calls", version)
        self._write(known.select("file", F.explode(F.array(F.lit("facts"), F.lit("links"))).alias("what")), "scope", version)
        self._commit(version, version, "full", reason, changed, known.count(), batch)

    def refresh(self, files: DataFrame, batch: int | None = None) -> None:
        """Bring the graph to the state of `files` (file, text: the whole set), by the smallest safe step."""
        head = self.head()
        if head is None:
            return self.rebuild(files, "no-baseline", 0, batch)
        now = files.select("file", F.sha2("text", 256).alias("digest"))
        both = now.withColumn("here", F.lit(True)).join(self.table("files").withColumnRenamed("digest", "was").withColumn("known", F.lit(True)), "file", "full_outer")
        kind = F.when(F.col("known").isNull(), "added").when(F.col("here").isNull(), "removed").when(~F.col("digest").eqNullSafe(F.col("was")), "changed")
        version = head.version + 1
        delta = self._write(both.select("file", kind.alias("how")).where("how is not null"), "delta", version)
        count = {r.how: r.n for r in delta.groupBy("how").agg(F.count("*").alias("n")).collect()}
        changed = count.get("changed", 0)
        if not count:
            return self._commit(version, head.base, "none", "unchanged", 0, 0, batch)
        if set(count) != {"changed"}:
            return self.rebuild(files, "files-changed", sum(count.values()), batch)
        if changed > self.most_changed:
            return self.rebuild(files, "too-many-changed", changed, batch)
        odd = delta.select(F.max(F.col("file").rlike(CONFIG)).alias("config"), F.min(javascript.is_javascript(F.col("file"))).alias("code")).first()
        if odd.config or not odd.code:
            return self.rebuild(files, "config-changed" if odd.config else "language", changed, batch)
        touched = F.broadcast(delta.select("file"))  # most_changed rows at most
        facts = self._write(javascript.facts(files.join(touched, "file")), "facts", version)
        old = self.table("facts")
        mine = old.join(touched, "file")
        if mine.unionByName(facts).where("kind = 'reexport'").limit(1).count():
            return self.rebuild(files, "barrel-changed", changed, batch)
        surface = ["file", "name", "kind", "imported", "spec", "type_only"]
        before, after = (f.where("fact = 'export'").select(surface).unionByName(f.where("fact = 'symbol' and exported").select("file", "name", "kind", "imported", F.lit(None).cast("string").alias("spec"), F.lit(None).cast("boolean").alias("type_only"))) for f in (mine, facts))
        if before.exceptAll(after).limit(1).count() or after.exceptAll(before).limit(1).count():
            return self.rebuild(files, "exports-changed", changed, batch)
        into = self.table("imports").select("file", F.col("target").alias("to")).unionByName(self.table("calls").select("file", F.split("target", "#")[0].alias("to"))).distinct()
        into = into.join(touched.withColumnRenamed("file", "to"), "to").select("file")
        affected = self._write(into.unionByName(delta.select("file")).distinct(), "affected", version)
        n = affected.count()
        if n > self.most_affected:
            return self.rebuild(files, "too-many-affected", changed, batch)
        # Facts of the affected files, and of the files that their names lead to.
        few = F.broadcast(affected)  # most_affected rows at most
        newest = old.join(touched, "file", "left_anti").unionByName(facts)
        own = self._write(newest.join(few, "file"), "relinked", version)
        found = self._write(linking.modules(linking.specs_of(own), now.select("file"), self.aliases), "modules", version)
        bound = self._write(linking.bindings_of(own, found), "bindings", version)
        source = self.table("origins").join(bound.select(F.col("target").alias("module")).distinct(), "module", "left_semi")
        reached = affected.unionByName(bound.select(F.col("target").alias("file"))).unionByName(source.select(F.col("origin").alias("file"))).where("file is not null").distinct()
        symbols = self._write(linking.symbols_of(newest.join(reached, "file", "left_semi")), "symbols", version)
        self._write(linking.file_imports(own, found), "imports", version)
        self._write(linking.link_calls(own, bound, source, symbols), "calls", version)
        self._write(now.join(touched, "file"), "files", version)
        self._write(delta.select("file", F.lit("facts").alias("what")).unionByName(affected.select("file", F.lit("links").alias("what"))), "scope", version)
        self._commit(version, head.base, "incremental", "importers" if n > changed else "changed-only", changed, n, batch)

    def sink(self, texts: str):
        """A function for `foreachBatch` over a stream of (file, text, removed, at): the latest row of a file in a batch holds.

        texts: a folder for the set of texts, version by version. A batch that is given again is left out by its number.
        """

        def run(batch: DataFrame, batch_id: int) -> None:
            if self.commits().where(F.col("batch") >= batch_id).limit(1).count():
                return
            last = batch.groupBy("file").agg(F.max(F.struct("at", "removed", "text")).alias("b")).select("file", "b.text", F.coalesce("b.removed", F.lit(False)).alias("removed"))
            before = self.commits().where("batch is not null").agg(F.max("batch")).first()[0]
            if before is not None:
                kept = self.spark.read.parquet(f"{texts}/b={before}")
                last = kept.join(last, "file", "left_anti").withColumn("removed", F.lit(False)).unionByName(last)
            path = f"{texts}/b={batch_id}"
            last.where("not removed").select("file", "text").write.mode("overwrite").parquet(path)
            self.refresh(self.spark.read.parquet(path), batch_id)

        return run
