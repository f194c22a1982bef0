"""One query for each operator of this subpackage, as the driver runs them, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pyspark.sql import functions as F

from orrery.llm import chat, codes, decontam, langid, lines, minhash, mixing, negatives, pii, quality, rules, suffix, toxicity


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_t(spark, sf_dir, "documents")).select("doc_id", "class_id", "is_kept")


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = lines.dedup_lines(_t(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(_t(spark, sf_dir, "documents"), _t(spark, sf_dir, "labels"))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(_t(spark, sf_dir, "documents"), _t(spark, sf_dir, "labels"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = rules.quality_rules(_t(spark, sf_dir, "documents"), _t(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rejected_by")


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.decontaminate(_t(spark, sf_dir, "documents"), _t(spark, sf_dir, "benchmark"))


def op7_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan, draws = mixing.mix(_t(spark, sf_dir, "documents"))
    return mixing.taken(plan, draws).select("doc_id", "size", "source_size", "target", "taken", "shards")


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.language(_t(spark, sf_dir, "documents"))


def op8_repeated_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.remove_repeats(_t(spark, sf_dir, "documents")).drop("kept")


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", own), (-1, 1, "assistant", own)], "conv_id long, turn long, role string, text string")
    turns = _t(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    done = chat.format_paths(chat.reply_tree(turns))
    read = done.select("conv_id", "formatted", chat.read_turns(F.col("formatted")).alias("turns"), chat.read_loss(F.col("formatted"), F.col("loss")).alias("under"))
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(lines, 256).alias("turns_sha256"),
        F.length("under").cast("long").alias("loss_chars"), F.sha2("under", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(_t(spark, sf_dir, "embeddings"), label)


def op12_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(_t(spark, sf_dir, "documents"))
    known = F.filter("spans", lambda s: s["base"])

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def number(kind):
        return F.size(F.filter(known, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [number(k) for k in pii.KINDS]
    return found.select("doc_id", *counts, F.sha2(joined(known), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = codes.compress(_t(spark, sf_dir, "embeddings"))
    return coded.select("vec_id", "code", "error", "label_error", F.lit(codes.digest(books)).alias("codebooks_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_near_duplicates": op1_near_duplicates,
    "op2_toxicity": op2_toxicity,
    "op3_quality_classifier": op3_quality_classifier,
    "op4_quality_rules": op4_quality_rules,
    "op5_decontaminate": op5_decontaminate,
    "op6_language": op6_language,
    "op7_mix_sources": op7_mix_sources,
    "op8_repeated_substrings": op8_repeated_substrings,
    "op9_chat_format": op9_chat_format,
    "op10_line_dedup": op10_line_dedup,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_personal_data": op12_personal_data,
    "op13_vector_codes": op13_vector_codes,
}

_CONTROL = r"(\|im_start\||\|im_end\||\|endoftext\||\|system\||\|user\||\|assistant\||/?s>|<SYS>>|</SYS>>|/?INST\])"

_FINITE = "embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0"


def _codes_sql(parts: int = 8, entries: int = 16, rounds: int = 6) -> str:
    """Plain Lloyd, one table a round; whole numbers throughout, floors by the remainder."""
    out = f"""
with recursive v as materialized (
  select row_number() over (order by vec_id, embedding) as rid, vec_id, label, list_transform(embedding, lambda x: cast(floor(4096 * cast(x as double)) as bigint)) as q from embeddings where {_FINITE}
), p as materialized (select rid, p, q[p * len(q) // {parts} + 1:(p + 1) * len(q) // {parts}] as x from v, range({parts}) as r(p)
), b0 as materialized (select p, rid - 1 as e, x as c from p where rid <= {entries})
"""
    far = "list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    for i in range(rounds + 1):
        out += f""", a{i} as materialized (
  select rid, p, x, cast((k).e as bigint) as e, cast((k).d as bigint) as d from (select rid, p.p, x, min(struct_pack(d := cast({far} as bigint), e := e)) as k from p join b{i} using (p) group by rid, p.p, x))
"""
        if i < rounds:
            out += f""", s{i} as (select p, e, j, cast(sum(x[j]) as bigint) as s, count(*) as n from a{i}, unnest(range(1, len(x) + 1)) as u(j) group by p, e, j
), b{i + 1} as materialized (
  select b.p, b.e, coalesce(m.c, b.c) as c from b{i} b left join (select p, e, list((s - ((s % n) + n) % n) // n order by j) as c from s{i} group by p, e) m using (p, e))
"""
    return out + f""", f as (select rid, string_agg(lpad(to_hex(e), 2, '0'), '' order by p) as code, cast(sum(d) as bigint) as error from a{rounds} group by rid)
select vec_id, lower(code) as code, error, cast(sum(error) over (partition by label) as bigint) as label_error,
  (select sha256(string_agg(array_to_string(c, ','), ',' order by p, e)) from b{rounds}) as codebooks_sha256
from v join f using (rid)
"""


ORACLE: dict[str, str] = {
    "op11_hard_negatives": f"""
with e as materialized (
  select row_number() over () as rid, vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
    list_transform(embedding, lambda x: floor(256 * cast(x as double))) as q
  from embeddings where vec_id is not null and label is not null and {_FINITE}
), s as materialized (
  select a.rid, a.vec_id as anchor_id, b.vec_id, a.label = b.label as same, cast(list_dot_product(a.q, b.q) as bigint) as score
  from e a join e b on len(a.q) = len(b.q) and a.vec_id <> b.vec_id where a.vec_id % 50 = 0
), p as materialized (
  select *, row_number() over (partition by rid order by score desc, vec_id) as k from s where same qualify k <= 5
), n as (
  select p.rid, p.k, p.anchor_id, p.vec_id as positive_id, s.vec_id as negative_id, p.score as positive_score, s.score as negative_score,
    row_number() over (partition by p.rid, p.k order by s.score desc, s.vec_id) as rank
  from p join s on p.rid = s.rid where not s.same and 50 * p.score <= 100 * s.score and 100 * s.score <= 95 * p.score
)
select anchor_id, positive_id, cast(rank as integer) as rank, negative_id, positive_score, negative_score from n where rank <= 3
""",
    "op13_vector_codes": _codes_sql(),
    "op5_decontaminate": r"""
with d as materialized (
  select row_number() over () as rid, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
  from documents
), b as (
  select cast(item_id as varchar) as item,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
  from benchmark
), bw as materialized (
  select distinct item, least(13, len(w)) as k, array_to_string(w[i:i + least(13, len(w)) - 1], ' ') as win
  from (select item, w, unnest(range(1, greatest(1, len(w) - 12) + 1)) as i from b where len(w) > 0)
), sizes as (select distinct k from bw
), dw as (
  select rid, k, i, array_to_string(w[i:i + k - 1], ' ') as win
  from (select rid, w, k, unnest(range(1, len(w) - k + 2)) as i from d, sizes where len(w) >= k)
), hit as materialized (select rid, dw.k, i, item from dw join bw on dw.k = bw.k and dw.win = bw.win
), cov as (select rid, count(*) as n_hit from (select distinct rid, unnest(range(i, i + k)) as p from hit) group by rid
), items as (select rid, count(*) as n_items, string_agg(item, ',' order by item) as s from (select distinct rid, item from hit where item is not null) group by rid)
select doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit, cast(coalesce(n_items, 0) as bigint) as n_items,
  sha256(coalesce(s, '')) as items_sha256, coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated
from d left join cov using (rid) left join items using (rid)
""",
    "op9_chat_format": rf"""
with turns as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -1, 0, 'user', '</s>[INST] ok [/INST]'
  union all select -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), kept as (
  select *, regexp_replace(replace(replace(role, '\', '\\'), chr(10), '\n'), '([<\[])(\\*){_CONTROL}', '\1\\\2\3', 'g') as shown_role,
    regexp_replace(text, '([<\[])(\\*){_CONTROL}', '\1\\\2\3', 'g') as shown
  from turns where conv_id is not null
)
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
  cast(coalesce(sum(length(text)) filter (where role = 'assistant'), 0) as bigint) as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (where role = 'assistant'), '')) as loss_sha256,
  cast(sum(length(shown) + length(shown_role) + 12 + 1 + 11) as bigint) as formatted_chars
from kept group by conv_id
""",
}
