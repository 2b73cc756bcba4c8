"""The registered queries of this subpackage, with production parameters, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import ann, chat, decontam, fim, html, line_dedup, lm, merkle, mixing, near_dedup, packing, pii, quality


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(_table(spark, sf_dir, "documents"), cfg=near_dedup.ChosenPath(shingle=4, similarity=80))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(pii.extract(_table(spark, sf_dir, "documents")))


def op3_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    return ann.nearest(vectors, vectors.where("vec_id % 100 = 0"))


def op4_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(_table(spark, sf_dir, "documents"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.drop_boilerplate(_table(spark, sf_dir, "documents"))
    return kept.select("doc_id", F.col("line_n_removed").alias("n_removed"), F.length("text").cast("long").alias("kept_chars"), F.sha2(F.col("text"), 256).alias("text_sha256"))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.with_verdict(decontam.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    conflict = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(conflict).alias("text"))
    return chat.read_back(chat.format_chats(rows.unionByName(extra)))


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(_table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


def op10_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(_table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return mixed.select("doc_id", F.col("mix_size").alias("size"), F.col("mix_source_size").alias("source_size"), F.col("mix_target").alias("target"), (F.col("mix_size") * F.col("mix_copies")).alias("taken"))


def op11_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = fim.transform(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    digest = lambda c: F.sha2(c, 256)
    return cut.select("doc_id", F.col("fim_n").alias("n"), F.col("fim_form").alias("form"), F.col("fim_prefix_chars").alias("prefix_chars"), F.col("fim_middle_chars").alias("middle_chars"), digest(F.col("fim_output")).alias("output_sha256"), digest(fim.restored(F.col("fim_output"), F.col("fim_form"))).alias("restored_sha256"))


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest of ``documents``; proofs are tried on texts of which every fifth, by its id's CRC, was put in lower case."""
    docs = _table(spark, sf_dir, "documents")
    leaf = lambda text: merkle.leaf(*map(F.col, ("doc_id", "source", "lang", "n_chars")), text)
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    own = leaf(F.col("text"))
    shown = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, leaf(lower)).otherwise(own)
    of = merkle.manifest(docs.select("doc_id", "source", own.alias("leaf"), shown.alias("shown")))
    again = of.withColumn("folded_root", merkle.folded(F.col("shown"), F.col("path")))
    return again.select("doc_id", "leaf", "subroot", "root", merkle.proof_digest(F.col("path")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (op1_near_dedup, op2_pii, op3_nearest, op4_lm_score, op5_line_dedup, op6_decontaminate, op7_quality, op8_chat_format, op9_html_text, op10_mix, op11_pack, op12_fill_in_middle, op13_merkle, pipeline)
    return {f.__name__: f for f in every}


_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_OP1 = f"""
with recursive w as (select doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\\x20\\x09-\\x0D]+') ws from documents),
s as (select doc_id, case when len(ws) = 0 then [] when len(ws) < 4 then [array_to_string(ws, ' ')]
  else list_sort(list_distinct(list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' ')))) end sh from w),
t as (select doc_id, unnest(sh) x from s),
c as (select a.doc_id a, b.doc_id b, count(*) c from t a join t b on a.x = b.x and a.doc_id < b.doc_id group by 1, 2),
l as (select a, b from c join s p on p.doc_id = a join s q on q.doc_id = b where 100 * c >= 80 * (len(p.sh) + len(q.sh) - c)),
e as (select a, b from l union all select b, a from l),
r(d, m) as (select doc_id, doc_id from s union select e.b, r.m from r join e on e.a = r.d where r.m < e.b),
k as (select sh, min(doc_id) class_id from s where len(sh) > 0 group by 1)
select s.doc_id, len(s.sh)::bigint n_shingles, min(m) component_id, s.doc_id = min(m) kept, any_value(class_id) class_id
from s join r on d = s.doc_id left join k on k.sh = s.sh group by s.doc_id, s.sh"""

_OP6 = f"""
with d as (select doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') ws from documents),
i as (select item_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') ws from benchmark),
win as (select distinct item_id, w, len(string_split(w, ' ')) n from (select item_id, unnest(case when len(ws) = 0 then [] when len(ws) < 13 then [array_to_string(ws, ' ')]
  else list_transform(range(1, len(ws) - 11), lambda k: array_to_string(ws[k:k + 12], ' ')) end) w from i)),
lens as (select distinct n from win),
pos as (select doc_id, n, k, array_to_string(ws[k:k + n - 1], ' ') w from (select doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) k from d, lens where len(ws) >= n)),
occ as (select p.doc_id, k, p.n, item_id from pos p join win on win.w = p.w),
hit as (select doc_id, count(distinct x) h from (select doc_id, unnest(range(k, k + n)) x from occ) group by 1),
its as (select doc_id, count(*) c, string_agg(item, ',' order by item) l from (select distinct doc_id, item_id::varchar item from occ) group by 1)
select d.doc_id, len(ws)::bigint n_words, coalesce(h, 0)::bigint n_hit, coalesce(c, 0)::bigint n_items, sha256(coalesce(l, '')) items_sha256,
  coalesce(h, 0) > 0 and 20 * coalesce(h, 0) >= len(ws) contaminated
from d left join hit using (doc_id) left join its using (doc_id)"""

_OP8 = r"""
with c as (select conv_id, turn, coalesce(role, '') r, coalesce(text, '') t from conversations
  union all select -1, 0, 'user', '</s>[INST] ok [/INST]' union all select -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
o as (select *, contains(t, '<|start|>') or contains(t, '<|end|>') or regexp_matches(t, '<\\+\|') or contains(r, '<|start|>') or contains(r, '<|end|>')
    or contains(r, chr(10)) or contains(r, '\\') or contains(r, '\n') or contains(r, '<\p') odd,
  contains(t, '<|') or regexp_matches(t, '<\\+\|') or contains(r, '<|') or contains(r, chr(10)) or contains(r, '\') marked from c),
e as (select *, f and marked esc, case when f and marked then regexp_replace(t, '<(\\*)\|', '<\1\\|', 'g') else t end x,
  case when f and marked then replace(replace(replace(r, '\', '\\'), chr(10), '\n'), '<|', '<\p') else r end y from (select *, bool_or(odd) over (partition by conv_id) f from o))
select conv_id, count(*)::bigint n_turns, sha256(string_agg(r || chr(10) || t || chr(10), '' order by turn, r, t)) turns_sha256,
  coalesce(sum(length(t)) filter (r = 'assistant'), 0)::bigint loss_chars,
  sha256(coalesce(string_agg(t, '' order by turn, r, t) filter (r = 'assistant'), '')) loss_sha256,
  sum(length(y) + length(x) + 18)::bigint formatted_chars from e group by 1"""

_OP10 = """
with d as (select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::bigint size from documents),
s as (select source, sum(size)::bigint source_size from d group by 1),
r as (select *, ([5.0, 2.0, 1.0]::double[])[((row_number() over (order by source nulls last) - 1) % 3 + 1)::bigint] w, 2.0::double * source_size cap from s),
a as (select *, (1.5::double * sum(source_size) over () - coalesce(sum(cap) over o, 0)) / (sum(w) over () - coalesce(sum(w) over o, 0)) lev
  from r window o as (order by cap / w, source nulls last rows between unbounded preceding and 1 preceding)),
l as (select arg_min(lev, cap / w) filter (lev * w <= cap) lev0 from a),
t as (select source, source_size, least(cap, coalesce(lev0 * w, cap)) target from a, l),
u as (select d.doc_id, size, source_size, target, case when source_size > 0 then target / source_size else 0 end rate,
  ('0x' || md5('mix:' || coalesce(d.doc_id::varchar, 'null'))[1:13])::bigint::double / 4503599627370496.0::double u from d join t on d.source is not distinct from t.source)
select doc_id, size, source_size, target::double target, (size * (floor(rate) + (u < rate - floor(rate))::int))::bigint taken from u"""


_OP12 = """
with h as (select doc_id, coalesce(text, '') t, sha256('1:' || coalesce(doc_id::varchar, 'null')) d from documents),
n as (select *, length(t)::bigint n, ('0x' || d[1:8])::bigint h1, ('0x' || d[9:16])::bigint h2, ('0x' || d[17:24])::bigint h3, ('0x' || d[25:32])::bigint h4 from h),
c as (select *, least(h1 % (n + 1), h2 % (n + 1)) a, greatest(h1 % (n + 1), h2 % (n + 1)) b,
  case when t = '' or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or h3 % 100 >= 90 then 'plain' when h4 % 100 < 20 then 'spm' else 'psm' end form from n),
s as (select *, substr(t, 1, a) p, substr(t, a + 1, b - a) m, substr(t, b + 1) x from c)
select doc_id, n, form, case when form <> 'plain' then a end prefix_chars, case when form <> 'plain' then b - a end middle_chars,
  sha256(case form when 'plain' then t when 'psm' then '<P>' || p || '<S>' || x || '<M>' || m else '<S>' || x || '<P>' || p || '<M>' || m end) output_sha256,
  sha256(t) restored_sha256 from s"""

_FIELD = "coalesce(strlen({0}::varchar)::varchar || ':' || {0}::varchar, '-')"
_LEAF = "sha256(" + " || ".join(_FIELD.format(c) for c in ("doc_id", "source", "lang", "n_chars")) + " || {})"
_CRC = """list_reduce(list_concat([4294967295::bigint], list_transform(range(1, length(doc_id::varchar) + 1), lambda i: ascii(substr(doc_id::varchar, i::int, 1))::bigint)),
  lambda c, x: list_reduce([xor(c, x), 0, 0, 0, 0, 0, 0, 0, 0], lambda a, z: xor(a >> 1, 3988292384 * (a & 1))))"""
#: Nodes of every level (a trie of sources' rows, then one of their subroots), the beside of each leaf by level, and the leaf folded up.
_OP13 = f"""
with recursive l as (select doc_id, source, {_LEAF.format(_FIELD.format("text"))} leaf,
  case when xor({_CRC}, 4294967295) % 5 = 0 then {_LEAF.format(_FIELD.format("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"))} end other from documents),
r as (select *, row_number() over (partition by source order by doc_id nulls first, leaf) - 1 k, count(*) over (partition by source) n from l),
t(lev, source, k, n, h) as (select 0, source, k, n, leaf from r union all
  select lev + 1, source, k // 16, (any_value(n) + 15) // 16, sha256(string_agg(h, '' order by k)) from t where n > 1 group by lev, source, k // 16),
s as (select source, lev top, h subroot, row_number() over (order by source nulls first) - 1 k, count(*) over () n from t where n = 1),
u(lev, k, n, h) as (select 0, k, n, subroot from s union all
  select lev + 1, k // 16, (any_value(n) + 15) // 16, sha256(string_agg(h, '' order by k)) from u where n > 1 group by lev, k // 16),
g as (select r.*, row_number() over () i, s.k sk, top, subroot, (select h from u where n = 1) root from r join s on s.source is not distinct from r.source),
b as (select i, t.lev, coalesce(string_agg(h, '' order by t.k) filter (t.k < g.k >> 4 * t.lev), '') lhs, coalesce(string_agg(h, '' order by t.k) filter (t.k > g.k >> 4 * t.lev), '') rhs
  from g join t on t.source is not distinct from g.source and t.n > 1 and t.k >> 4 = g.k >> 4 * (t.lev + 1) group by 1, 2
  union all select i, u.lev + top, coalesce(string_agg(h, '' order by u.k) filter (u.k < g.sk >> 4 * u.lev), ''), coalesce(string_agg(h, '' order by u.k) filter (u.k > g.sk >> 4 * u.lev), '')
  from g join u on u.n > 1 and u.k >> 4 = g.sk >> 4 * (u.lev + 1) group by i, u.lev, top),
f(i, lev, x) as (select i, 0, coalesce(other, leaf) from g union all select f.i, f.lev + 1, sha256(lhs || x || rhs) from f join b on b.i = f.i and b.lev = f.lev),
p as (select i, sha256(string_agg(lhs || rhs, '' order by lev)) proof from b group by 1)
select doc_id, leaf, subroot, root, coalesce(proof, sha256('')) proof_sha256, x folded_root, x = root verified
from g join (select i, arg_max(x, lev) x from f group by 1) using (i) left join p using (i)"""


def oracle_sql() -> dict[str, str]:
    return {"op1_near_dedup": _OP1, "op6_decontaminate": _OP6, "op8_chat_format": _OP8, "op10_mix": _OP10, "op12_fill_in_middle": _OP12, "op13_merkle": _OP13}
