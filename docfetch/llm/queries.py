"""The registered queries; each applies its operator to the whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docfetch.llm import (bpe, decontaminate, filter_audit, html_text, jaccard_join, katz, merkle, pii, risk_rules,
                          substring, suffix_buckets, token_order, weak_quality)

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def vocabulary(spark: SparkSession, name: str = VOCABULARY) -> tuple[dict[bytes, int], str]:
    import public_tokenizers

    return bpe.read_ranks(spark, public_tokenizers.path(name)), public_tokenizers.PATTERN


@query
def op1_decontamination(spark, sf_dir):
    out = decontaminate.decontaminate(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return out.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"),
                      F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"),
                      (F.col("n_hit") > 0).alias("contaminated"))


ORACLE["op1_decontamination"] = r"""
with dw as (
  select doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) as w from documents),
iw as (
  select item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
win as (
  select distinct item_id, least(10, len(w)) as n, array_to_string(w[i + 1:i + least(10, len(w))], ' ') as k
  from (select item_id, w, unnest(range(len(w) - least(10, len(w)) + 1)) as i from iw where len(w) > 0)),
sizes as (select distinct n from win),
dwin as (
  select doc_id, n, i, array_to_string(w[i + 1:i + n], ' ') as k
  from (select doc_id, w, n, unnest(range(len(w) - n + 1)) as i from dw, sizes where len(w) >= n)),
hit as (select d.doc_id, d.i, d.n, v.item_id from dwin d join win v on v.n = d.n and v.k = d.k),
cov as (select doc_id, count(*) as n_hit from (
  select distinct doc_id, unnest(range(i, i + n)) as p from (select distinct doc_id, i, n from hit)) group by 1),
ids as (select doc_id, count(*) as n_items, string_agg(id, ',' order by id) as ids
  from (select distinct doc_id, cast(item_id as varchar) as id from hit) group by 1)
select dw.doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
  sha256(coalesce(ids, '')) as items_sha256, n_hit is not null as contaminated
from dw left join cov on cov.doc_id = dw.doc_id left join ids on ids.doc_id = dw.doc_id
"""


@query
def op2_substring_dedup(spark, sf_dir):
    out = substring.dedup_substrings(documents(spark, sf_dir), window=20)
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept"), 256).alias("kept_sha256"))


ORACLE["op2_substring_dedup"] = r"""
with dw as (select doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) as w from documents),
win as (select doc_id, i, md5(array_to_string(w[i + 1:i + 20], ' ')) as k
  from (select doc_id, w, unnest(range(len(w) - 19)) as i from dw where len(w) >= 20)),
dup as (select doc_id, i from (
  select doc_id, i, row_number() over (partition by k order by doc_id, i) as r from win) where r > 1),
gone as (select distinct doc_id, unnest(range(i, i + 20)) as p from dup),
word as (select doc_id, unnest(range(len(w))) as p, unnest(w) as x from dw),
kept as (select word.doc_id, string_agg(x, ' ' order by word.p) as t, count(*) as n
  from word anti join gone on gone.doc_id = word.doc_id and gone.p = word.p group by 1)
select dw.doc_id, cast(len(w) as bigint) as n_words, len(w) - coalesce(n, 0) as n_removed,
  sha256(coalesce(t, '')) as kept_sha256
from dw left join kept on kept.doc_id = dw.doc_id
"""


@query
def op3_katz_lm(spark, sf_dir):
    return katz.score(documents(spark, sf_dir))


@query
def op4_jaccard_join(spark, sf_dir):
    found = jaccard_join.groups(documents(spark, sf_dir), n=3, num=90, compression="uncompressed")
    return found.select("doc_id", "n_shingles", "component_id")


ORACLE["op4_jaccard_join"] = r"""
with recursive dw as (select doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) as w from documents),
sh as (select distinct doc_id, md5(array_to_string(w[i + 1:i + 3], ' ')) as k
  from (select doc_id, w, unnest(range(greatest(len(w) - 2, 1))) as i from dw where len(w) > 0)),
size as (select doc_id, count(*) as n from sh group by 1),
both_in as (select a.doc_id as a, b.doc_id as b, count(*) as both_n
  from sh a join sh b on a.k = b.k and a.doc_id <> b.doc_id group by 1, 2),
link as (select a, b from both_in join size x on x.doc_id = a join size y on y.doc_id = b
  where 100 * both_n >= 90 * (x.n + y.n - both_n)),
reach as (select doc_id as a, doc_id as b from documents
  union select reach.a, link.b from reach join link on link.a = reach.b)
select d.doc_id, coalesce(n, 0) as n_shingles, c as component_id
from documents d left join size on size.doc_id = d.doc_id
join (select a, min(b) as c from reach group by 1) on a = d.doc_id
"""


@query
def op5_pii(spark, sf_dir):
    found = pii.find_pii(documents(spark, sf_dir).select("doc_id", "text"))
    base = F.filter("pii", lambda s: s["base"])
    of_kind = lambda k: F.size(F.filter(base, lambda s: s["kind"] == k))
    counts = [of_kind(k).cast("long").alias(f"n_{kind}") for k, kind in enumerate(pii.KINDS)]
    return found.select("doc_id", *counts, F.sha2(pii.render(base), 256).alias("base_sha256"),
                        pii.render(F.col("pii")).alias("spans"))


@query
def op6_risk_rules(spark, sf_dir):
    out = risk_rules.apply_rules(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                      "base_failed", "kept")


ORACLE["op6_risk_rules"] = r"""
with dw as (select doc_id, lang, coalesce(text, '') as text,
    coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) as w,
    [x for x in string_split(coalesce(text, ''), chr(10)) if regexp_matches(x, '[^\x20\x09-\x0D]')] as lines
  from documents),
gram as (select doc_id, i, array_to_string(w[i + 1:i + 5], ' ') as k
  from (select doc_id, w, unnest(range(len(w) - 4)) as i from dw where len(w) >= 5)),
rep as (select doc_id, count(*) as n from (
  select distinct doc_id, unnest(range(i, i + 5)) as p from (
    select doc_id, i, count(*) over (partition by doc_id, k) as c from gram) where c > 1) group by 1),
f as (select dw.doc_id, lang, cast(len(w) as bigint) as n_words,
    cast(length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) as bigint) as word_chars,
    cast(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) as bigint) as n_symbols,
    cast(len(lines) as bigint) as n_lines,
    cast(len(lines) - len(list_distinct(lines)) as bigint) as n_dup_lines, coalesce(rep.n, 0) as n_repeat_words
  from dw left join rep on rep.doc_id = dw.doc_id),
b as (select *, __BASE__ as base_failed from f),
test as (__TESTS__),
good as (select doc_id from labels where quality is not null group by 1 having min(quality) = 1),
t as (select coalesce(lang, '') as lang, rule, cutoff, count(*) as n, count(*) filter (where rejects) as k
  from test where not base_failed and doc_id in (select doc_id from good) group by 1, 2, 3),
p as (select *, case when k >= n * __SHARE__ then 1.0 else (
    select sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln(__SHARE__) + (n - i) * ln(1 - __SHARE__)))
    from unnest(range(k + 1)) as r(i)) end as p_value from t),
holm as (select *, p_value * (count(*) over () - (rank() over (order by p_value) - 1)) as adjusted from p),
certified as (select * from holm
  where p_value < coalesce((select min(p_value) from holm where adjusted > __DELTA__), 2)),
rejected as (select distinct doc_id from test join certified c
  on c.lang = coalesce(test.lang, '') and c.rule = test.rule and c.cutoff = test.cutoff where rejects)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  not base_failed and doc_id not in (select doc_id from rejected) as kept
from b
""".replace("__BASE__", risk_rules.BASE_FAILED).replace("__SHARE__", repr(0.05 / len(risk_rules.RULES))).replace(
    "__DELTA__", "0.05").replace("__TESTS__", " union all ".join(
        f"select doc_id, lang, base_failed, '{rule}' as rule, {cutoff} as cutoff, {left} > {right} * {cutoff} as rejects from b"
        for rule, (left, right, cutoffs) in risk_rules.RULES.items() for cutoff in cutoffs))


@query
def op7_weak_quality(spark, sf_dir):
    judged = weak_quality.classify(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return judged.select("doc_id", "quality_score", "quality_accepted")


@query
def op8_token_order(spark, sf_dir):
    ranks, pattern = vocabulary(spark)
    return token_order.slots(token_order.materialise(documents(spark, sf_dir), ranks, pattern))


@query
def op9_byte_bpe(spark, sf_dir):
    ranks, pattern = vocabulary(spark)
    out = bpe.encode_and_decode(documents(spark, sf_dir), ranks, pattern)
    return out.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
                      F.sha2(F.col("ids"), 256).alias("ids_sha256"),
                      F.sha2(F.col("decoded"), 256).alias("decoded_sha256"))


@query
def op10_suffix_dedup(spark, sf_dir):
    out = suffix_buckets.dedup_suffixes(documents(spark, sf_dir))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2(F.col("kept"), 256).alias("kept_sha256"))


@query
def op11_filter_audit(spark, sf_dir):
    return filter_audit.audit(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


ORACLE["op11_filter_audit"] = r"""
with dw as (select doc_id, coalesce(lang, '') as part, coalesce(text, '') as text,
    coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) as w from documents),
judged as (select doc_id, part, [len(w) < 100, 100 * len(list_distinct(w)) < 80 * len(w),
    100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * length(text), regexp_matches(text, '[#$%&*|]'),
    coalesce(doc_id > min(doc_id) over (partition by text), false)] as fails from dw),
label as (select doc_id, max(quality = 1) as good, max(toxic = 1) as toxic from labels group by 1),
cell as (select part, fails, count(*) as n, count(*) filter (where good) as g, count(*) filter (where toxic) as x
  from judged left join label using (doc_id) group by 1, 2),
letter as (select unnest(range(1, 6)) as k, chr(cast(64 + unnest(range(1, 6)) as integer)) as c),
filter_orders as (select [a.k, b.k, c.k, d.k, e.k] as ks, a.c || b.c || c.c || d.c || e.c as filter_order
  from letter a, letter b, letter c, letter d, letter e where len(list_distinct([a.k, b.k, c.k, d.k, e.k])) = 5),
play as (select part, filter_order, s as step, ks[s] as own, n, g, x, fails[ks[s]] as f,
    len(list_filter(ks[1:s - 1], lambda k: fails[k])) > 0 as gone,
    fails[ks[s]] and len(list_filter(fails, lambda y: y)) = 1 as alone
  from cell, filter_orders, range(1, 6) as r(s)),
counted as (select part, filter_order, step, own,
    coalesce(sum(n) filter (where not f and not gone), 0) as kept, coalesce(sum(n) filter (where f and not gone), 0) as removed,
    coalesce(sum(n) filter (where f and gone), 0) as redundant, coalesce(sum(n) filter (where alone), 0) as unique_fails,
    coalesce(sum(g) filter (where f and not gone), 0) as good_lost,
    coalesce(sum(x) filter (where f and not gone), 0) as toxic_lost
  from play group by 1, 2, 3, 4)
select part, filter_order, cast(step as integer) as step, cast(kept as bigint) as kept, cast(removed as bigint) as removed,
  cast(redundant as bigint) as redundant, cast(unique_fails as bigint) as unique_fails,
  cast(good_lost as bigint) as good_lost, cast(toxic_lost as bigint) as toxic_lost,
  cast(sum(removed) over (partition by part, own) as bigint) as shapley
from counted
"""


@query
def op12_merkle_manifest(spark, sf_dir):
    tamper, tampered = merkle.lower_cased()
    return merkle.manifest(documents(spark, sf_dir), tamper=tamper, tampered=tampered).drop("part")


def _merkle_sql(fanout: int = 8, levels: int = 7, tops: int = 3) -> str:
    """Level by level: h the nodes, c how many the part has; a document's place is i // fanout^level.
    ``levels`` are enough for fanout^levels documents of a language, ``tops`` for fanout^tops languages."""
    field = lambda c: f"coalesce(strlen(cast({c} as varchar)) || ':' || {c}, '-')"
    leaf = lambda text: f"sha256(concat({', '.join(map(field, ['doc_id', 'source', 'lang', 'n_chars']))}, {field(text)}))"
    step = "list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: case when x & 1 = 1 then xor(x >> 1, 3988292384) else x >> 1 end)"
    crc = (f"xor(list_reduce([4294967295] || [cast(ascii(x) as bigint) for x in string_split(cast(doc_id as varchar), '')], "
           f"lambda c, b: {step}), 4294967295)")
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    sql = f"""
with crcs as (select *, {crc} as crc from documents),
d as (select doc_id, dense_rank() over (order by lang nulls first) - 1 as p, {leaf('text')} as leaf,
  case when crc % 3 = 0 then {leaf(lower)} else {leaf('text')} end as other from crcs),
at0 as (select *, row_number() over (partition by p order by doc_id nulls first, leaf) - 1 as i, other as f, '' as proof from d),
h0 as (select p, i, leaf as h, count(*) over (partition by p) as c from at0)"""

    def level(k: int, h: str, at: str, own: str, part: str) -> str:
        run = f"run_{h}{k}"
        return f""",
{run} as (select {part} as p, i // {fanout} as j, any_value(c) as c, list(h order by i) as hs from {h}{k} group by all),
{h}{k + 1} as (select p, j as i, case when c = 1 then hs[1] else sha256(array_to_string(hs, '')) end as h,
  count(*) over (partition by p) as c from {run}),
{at}{k + 1} as (select a.* replace (a.{own} // {fanout} as {own},
    case when c = 1 then f else sha256(array_to_string(hs[1:a.{own} % {fanout}] || [f] || hs[a.{own} % {fanout} + 2:], '')) end as f,
    case when c = 1 then proof else proof || array_to_string(hs[1:a.{own} % {fanout}] || hs[a.{own} % {fanout} + 2:], '') end as proof)
  from {at}{k} a join {run} r on r.j = a.{own} // {fanout} and {'r.p = a.p' if part == 'p' else 'true'})"""

    for k in range(levels):
        sql += level(k, "h", "at", "i", "p")
    sql += f""",
t0 as (select 0 as p, p as i, h, count(*) over () as c from h{levels}),
up0 as (select a.*, a.p as q, s.h as subroot from at{levels} a join h{levels} s on s.p = a.p)"""
    for k in range(tops):
        sql += level(k, "t", "up", "q", "0")
    return sql + f"""
select doc_id, leaf, subroot, h as root, sha256(proof) as proof_sha256, f as folded_root, f = h as verified
from up{tops}, t{tops}"""


ORACLE["op12_merkle_manifest"] = _merkle_sql()


@query
def op13_html_text(spark, sf_dir):
    return html_text.extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
