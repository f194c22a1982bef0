"""Unified diffs as tables, by windows over their lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

_HUNK = r"^@@ -(\d+)(?:,\d+)? \+(\d+)(?:,\d+)? @@"


def unified_diff(diffs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(files, lines) of `git diff` texts: diff, text.

    files: diff, file (the new path, or the old one where it is deleted), old_file, is_new, is_deleted, is_renamed, is_binary.
    lines: diff, file, kind, old_line, new_line, text; an added line has no old_line, a removed one the new_line it would be at.
    One diff is one window. Paths that git quotes stay as they are quoted. Null texts have no files.
    """
    rows = diffs.select("diff", F.posexplode(F.split("text", "\r?\n")).alias("n", "l"))
    of = lambda *by: W.partitionBy("diff", *by).orderBy("n").rowsBetween(W.unboundedPreceding, W.currentRow)
    rows = rows.withColumn("f", F.sum(F.col("l").startswith("diff --git ").cast("int")).over(of())).where("f > 0")
    rows = rows.withColumn("is_hunk", F.col("l").rlike(_HUNK)).withColumn("h", F.sum(F.col("is_hunk").cast("int")).over(of("f")))
    found = lambda pattern: F.max(F.when((F.col("h") == 0) & F.col("l").rlike(pattern), F.regexp_extract("l", pattern, 1)))
    starts = lambda *x: F.bool_or((F.col("h") == 0) & F.coalesce(*[F.when(F.col("l").startswith(y), True) for y in x], F.lit(False)))
    old, new = found(r"^(?:--- a/|rename from )([^\t]*)"), found(r"^(?:\+\+\+ b/|rename to )([^\t]*)")
    head = (found(r"^diff --git a/(\S+) b/\S+$"), found(r"^diff --git a/\S+ b/(\S+)$"))
    files = rows.groupBy("diff", "f").agg(
        F.coalesce(old, head[0]).alias("old_file"), F.coalesce(new, head[1]).alias("new_file"), starts("new file mode ", "--- /dev/null").alias("is_new"),
        starts("deleted file mode ", "+++ /dev/null").alias("is_deleted"), starts("rename from ", "rename to ").alias("is_renamed"), starts("Binary files ", "GIT binary patch").alias("is_binary"),
    )
    files = files.select("diff", "f", F.when(F.col("is_deleted"), F.col("old_file")).otherwise(F.col("new_file")).alias("file"), F.when(~F.col("is_new"), F.col("old_file")).alias("old_file"), "is_new", "is_deleted", "is_renamed", "is_binary")
    body = rows.where("h > 0").where(~F.col("l").startswith("\\ No newline"))
    start = lambda k: F.first(F.when(F.col("is_hunk"), F.regexp_extract("l", _HUNK, k).cast("int")), ignorenulls=True).over(of("f", "h"))
    mark = F.substring("l", 1, 1)
    before = lambda not_: F.coalesce(F.sum((~F.col("is_hunk") & (mark != not_)).cast("int")).over(of("f", "h").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    body = body.select("diff", "f", "is_hunk", mark.alias("m"), F.substring("l", 2, 1 << 30).alias("text"), (start(1) + before("+")).cast("int").alias("old"), (start(2) + before("-")).cast("int").alias("new_line"))
    body = body.where("not is_hunk and m in ('+', '-')")
    lines = body.join(files.select("diff", "f", "file"), ["diff", "f"]).select("diff", "file", F.when(F.col("m") == "+", "added").otherwise("removed").alias("kind"), F.when(F.col("m") == "-", F.col("old")).alias("old_line"), "new_line", "text")
    return files.drop("f"), lines
