"""Extraction, readers and event windows bound to the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from orrery.plans.star import table
from orrery.sources import readers, scan
from orrery.streaming import activity

QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


@query("with h as (select page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) as target from pages) select page_id, target, count(*) as n from h group by 1, 2")
def extract_html_links(spark, d):
    """S3f: href edges of markup"""
    return scan.html_links(table(spark, d, "pages").select(F.col("page_id").alias("file"), F.col("html").alias("text"))).withColumnRenamed("file", "page_id")


_DDL = "'create table t' || p_partkey % 7 || ' (a int); select * from t' || p_partkey % 5 || ' join v' || p_partkey % 3 || ' on 1 = 1; insert into t' || p_partkey % 4 || ' values (1)'"


@query("select p_partkey as file, 'table' as kind, 't' || p_partkey % 7 as name from part")
def extract_sql_objects(spark, d):
    """S3g"""
    return scan.sql_objects(table(spark, d, "part").select(F.col("p_partkey").alias("file"), F.expr(_DDL).alias("text")))


@query("with r as (select p_partkey as file, unnest(['t' || p_partkey % 5, 'v' || p_partkey % 3, 't' || p_partkey % 4]) as name, unnest(['from', 'join', 'insert into']) as verb from part) select file, verb, name from r")
def extract_sql_references(spark, d):
    """S3g, S3h"""
    return scan.sql_references(table(spark, d, "part").select(F.col("p_partkey").alias("file"), F.expr(_DDL).alias("text")))


@query("select p_partkey as file, 'f' || p_partkey as name, 'function' as kind, 2::int as line from part union all select p_partkey, 'K', 'class', 4 from part union all select p_partkey, 'K.m', 'method', 5 from part")
def extract_python_symbols(spark, d):
    """Definitions by the syntax tree"""
    text = F.concat(F.lit("import os\ndef f"), "p_partkey", F.lit("(a, b):\n    return os.path.join(a, b)\nclass K:\n    def m(self):\n        return f"), "p_partkey", F.lit("(1, 2)\n"))
    return scan.python_symbols(table(spark, d, "part").select(F.col("p_partkey").alias("file"), text.alias("text"))).select("file", "name", "kind", "line")


@query("select o_orderkey as file, l as line, h as hits from orders, (values (1, 3::bigint), (2, 0::bigint)) v(l, h)")
def readers_coverage_lcov(spark, d):
    """S9"""
    rep = F.concat(F.lit("SF:"), "o_orderkey", F.lit("\nDA:1,3\nDA:2,0\nDA:x,1\nend_of_record\n"))
    return readers.lcov(table(spark, d, "orders").select(rep.alias("text"))).withColumn("file", F.col("file").cast("long"))


@query("select 'c' || o_orderkey as \"commit\", o_orderkey::bigint as ts, 'a.py' as file, 3::bigint as additions, 1::bigint as deletions, false as is_binary from orders union all select 'c' || o_orderkey, o_orderkey, 'b.bin', 0, 0, true from orders")
def readers_git_numstat(spark, d):
    """S5"""
    log = F.concat(F.lit("\x1ec"), "o_orderkey", F.lit("\x1f"), "o_orderkey", F.lit("\x003\t1\ta.py\x00-\t-\tb.bin\x00"))
    return readers.numstat(table(spark, d, "orders").select(log.alias("text")))


@query("select c_custkey as file, 'lib' || c_custkey % 9 as name, '1.' || c_custkey % 4 as version, 'dependencies' as section from customer union all select c_custkey, 'tool', '^2', 'devDependencies' from customer")
def readers_package_manifest(spark, d):
    """S10"""
    text = F.concat(F.lit('{"dependencies": {"lib'), F.col("c_custkey") % 9, F.lit('": "1.'), F.col("c_custkey") % 4, F.lit('"}, "devDependencies": {"tool": "^2"}}'))
    return readers.package_json(table(spark, d, "customer").select(F.col("c_custkey").alias("file"), text.alias("text")))


@query("select event_type, date_trunc('day', ts) as day, count(*) as n, round(sum(value), 4) as total from events group by 1, 2")
def streaming_daily_activity(spark, d):
    """T5 and the event extension: the batch form of the watermarked stream"""
    return activity.daily(table(spark, d, "events")).select("event_type", F.col("window.start").alias("day"), "n", F.round("total", 4).alias("total"))
