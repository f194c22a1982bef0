"""Archives made from the test tables, and code tokens of the documents."""

from __future__ import annotations

import io
import zipfile

import pyarrow as pa
from pyspark.sql import functions as F

from orrery.operators import clones
from orrery.plans.star import table
from orrery.sources import archives

QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def jars(spark, d):
    """path, content: an archive for each supplier, with a class of its own, one inside it, a shared one in two versions, and entries that are no class."""

    def run(batches):
        for batch in batches:
            keys, out = batch.column("k").to_pylist(), []
            for k in keys:
                body = io.BytesIO()
                with zipfile.ZipFile(body, "w") as z:
                    for name in ("META-INF/MANIFEST.MF", f"org/s{k % 5}/Main{k}.class", f"org/s{k % 5}/Main{k}$In.class", f"lib/Util{k % 3}.class", f"META-INF/versions/11/lib/Util{k % 3}.class", "module-info.class", "org/package-info.class", "Top.class"):
                        z.writestr(name, b"x" * (k % 7))
                    z.comment = b"c" * (k % 100)
                out.append(b"no archive" if k % 9 == 8 else body.getvalue())
            yield pa.record_batch([pa.array([f"j{k}.jar" for k in keys]), pa.array(out, pa.binary())], names=["path", "content"])

    return table(spark, d, "supplier").select(F.col("s_suppkey").alias("k")).mapInArrow(run, "path string, content binary")


_C = """c as (select 'j' || k || '.jar' as path, v.* from (select s_suppkey as k from supplier), lateral (values ('org.s' || k % 5, 'org.s' || k % 5 || '.Main' || k), ('org.s' || k % 5 || '.Main' || k, 'org.s' || k % 5 || '.Main' || k || '.In'), ('lib', 'lib.Util' || k % 3), ('', 'Top')) v(package, name) where k % 9 <> 8)"""


@query(f"with {_C} select path, package, name, null as error from c union all select 'j' || s_suppkey || '.jar', null, null, 'no central directory' from supplier where s_suppkey % 9 = 8")
def jar_class_names(spark, d):
    """Class names by the central directory"""
    return archives.jar_classes(jars(spark, d))


@query(f"with {_C}, i as (select distinct case when p_partkey % 2 = 0 then 'org.s' || p_partkey % 7 || '.*' else 'lib.Util' || p_partkey % 4 end as name from part) select distinct i.name, path from i join c on (i.name not like '%*' and c.name = i.name) or (i.name like '%.*' and c.package || '.*' = i.name)")
def jar_import_owners(spark, d):
    """Imports to the archives that hold their class or package"""
    k = F.col("p_partkey")
    names = F.when(k % 2 == 0, F.concat(F.lit("org.s"), k % 7, F.lit(".*"))).otherwise(F.concat(F.lit("lib.Util"), k % 4))
    return archives.import_owners(table(spark, d, "part").select(names.alias("name")), archives.jar_classes(jars(spark, d)))


_KEY = "('0x' || substr(md5({0}), 1, 15))::bigint"
_WORDS = ", ".join(f"'{w}'" for w in sorted(set(clones.KEYWORDS)))
_T = f"""t as materialized (select doc_id as id, list_transform(regexp_extract_all(coalesce(text, ''), '{clones._CODE}'), lambda x: case when regexp_matches(x, '^[0-9]') then 'N:' || x else x end) as strict from documents),
r as materialized (select id, strict, list_transform(strict, lambda x: case when regexp_matches(x, '^[A-Za-z_$]') and not starts_with(x, 'N:') and not list_contains([{_WORDS}], x) then 'I' else x end) as renamed from t)"""


def _prints_sql(form: str) -> str:
    gram = _KEY.format(f"array_to_string({form}[i:i + 7], ' ')")
    number = _KEY.format("'numeric:' || x")
    return f"""g_{form} as materialized (select id, list_transform(range(1, len({form}) - 6), lambda i: {gram}) as g, list_transform(list_filter({form}, lambda x: starts_with(x, 'N:')), lambda x: {number}) as a from r where len({form}) >= 11),
w_{form} as (select distinct id, unnest(list_concat(list_transform(range(1, len(g) - 1), lambda i: list_min(g[i:i + 3])), a)) as fp from g_{form})"""


@query(f"with {_T}, {_prints_sql('strict')}, {_prints_sql('renamed')} select id, 'strict' as form, count(*) as n, cast(sum(fp % 1000003) as bigint) as total from w_strict group by id union all select id, 'renamed', count(*), cast(sum(fp % 1000003) as bigint) from w_renamed group by id")
def clones_code_fingerprints(spark, d):
    """Code tokens as they are and with names renamed, winnowed, with exact anchors of numeric tokens"""
    tokens = clones.code_tokens(table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text"))
    both = [clones.code_fingerprints(tokens, form).select("id", F.lit(form).alias("form"), "fp") for form in ("strict", "renamed")]
    return both[0].unionByName(both[1]).groupBy("id", "form").agg(F.count("*").alias("n"), F.sum(F.col("fp") % 1000003).cast("long").alias("total"))
