"""JAR listings from files and bytes, and code tokens."""

import io
import re
import zipfile

from pyspark.sql import functions as F

from orrery.operators import clones
from orrery.sources import archives, javascript


def jar(names, comment=b"", body=b""):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for n in names:
            z.writestr(n, body)
        z.comment = comment
    return out.getvalue()


NAMES = ["a/B.class", "a/B$C.class", "META-INF/versions/9/a/B.class", "META-INF/versions/x/D.class", "Top.class", "module-info.class", "a/package-info.class", "a/note.txt", "é/Ü.class"]
WANT = [("", "Top"), ("META-INF.versions.x", "META-INF.versions.x.D"), ("a", "a.B"), ("a.B", "a.B.C"), ("é", "é.Ü")]


def test_only_the_end_is_read():
    content = jar(NAMES, b"x" * 60000, b"y" * 400_000)
    read = []

    def at(offset, n):
        read.append(n)
        return content[offset : offset + n]

    assert archives.classes(archives.entries(at, len(content))) == sorted(WANT)
    assert sum(read) < 70_000 < len(content)
    many = jar([f"p/C{i}.class" for i in range(3000)])  # the directory is longer than the tail
    assert len(archives.classes(archives.entries(lambda o, n: many[o : o + n], len(many)))) == 3000


def test_archives_as_a_source_and_as_bytes(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.jar").write_bytes(jar(NAMES))
    (tmp_path / "sub" / "b.jar").write_bytes(b"no archive")
    (tmp_path / "sub" / "empty.jar").write_bytes(jar([]))
    (tmp_path / "c.txt").write_bytes(jar(NAMES))
    spark.dataSource.register(archives.JarSource)
    got = spark.read.format("jar_classes").load(str(tmp_path))
    assert sorted((r.path.rsplit("/", 1)[1], r.package, r.name, r.error) for r in got.collect() if r.name) == sorted(("a.jar", p, n, None) for p, n in WANT)
    assert [(r.path.rsplit("/", 1)[1], r.error) for r in got.where("error is not null").collect()] == [("b.jar", "no central directory")]
    assert spark.read.format("jar_classes").load("file://" + str(tmp_path / "a.jar")).count() == len(WANT)
    assert spark.read.format("jar_classes").load(str(tmp_path / "none")).count() == 0
    df = spark.createDataFrame([("x", jar(NAMES)), ("y", b""), ("z", None), ("t", jar(NAMES)[:-30])], "path string, content binary")
    rows = archives.jar_classes(df)
    assert {(r.path, r.error is None) for r in rows.collect()} == {("x", True), ("y", False), ("t", False)}
    asked = spark.createDataFrame([("a.B",), ("a.*",), ("a",), (None,), ("no.*",), (".*",)], "name string")
    assert sorted((r.name, r.path) for r in archives.import_owners(asked, rows).collect()) == [(".*", "x"), ("a.*", "x"), ("a.B", "x")]


def plain(text, form):
    out = []
    for t in re.findall(clones._CODE, text or ""):
        if t[0].isdigit():
            out.append("N:" + t)
        elif form == "renamed" and re.match("[A-Za-z_$]", t) and t not in clones.KEYWORDS:
            out.append("I")
        else:
            out.append(t)
    return out


def test_code_tokens_and_anchors(spark):
    texts = [None, "", "if (x) { return y1 + 0xFF_n * 1.5e-3 - .5 }", "const $a = été @ b_2; // 12n 0b10", "for (let i = 0; i < 10; i++) { total += prices[i] * 3; }", "for (let k = 0; k < 10; k++) { sum += costs[k] * 3; }", "for (let k = 0; k < 11; k++) { sum += costs[k] * 3; }"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    tokens = clones.code_tokens(df)
    for r in tokens.collect():
        assert r.strict == plain(texts[r.id], "strict") and r.renamed == plain(texts[r.id], "renamed")
    prints = {f: {} for f in ("strict", "renamed")}
    for f, got in prints.items():
        for r in clones.code_fingerprints(tokens, f).collect():
            got.setdefault(r.id, set()).add(r.fp)
    assert prints["renamed"][4] == prints["renamed"][5] and prints["strict"][4] != prints["strict"][5]
    assert prints["renamed"][5] != prints["renamed"][6] and len(prints["renamed"][5] & prints["renamed"][6]) > 3  # another number is another anchor
    assert set(prints["strict"]) == {i for i, t in enumerate(texts) if len(plain(t, "strict")) >= 11}


def test_strings_are_no_code_once_masked(spark):
    df = spark.createDataFrame([("a.js", "f('x y z') // note\n+ `t ${g} u`")], "file string, text string")
    got = clones.code_tokens(javascript.masked(df).select(F.col("file").alias("id"), "text")).first()
    assert got.strict[:6] == ["f", "(", "'", "'", ")", "+"] and "g" in got.strict and not {"x", "y", "z", "note", "t", "u"} & set(got.strict)
