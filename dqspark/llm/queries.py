"""The registered queries, each applying one operator to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from . import bpe, decontam, html, langid, licenses, negatives, pii, quality, simhash, substrings, urls, vectors, whitening
from . import chat as chat_format
from .registry import register, table


def training_rows(docs):
    """Documents the language model may learn from, and whether a document is held out."""
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    return docs.where(~held_out), held_out


@register("op2_language_id")
def language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    learn, held_out = training_rows(docs)
    marked = docs.select("doc_id", held_out.alias("held_out"), "text")
    return langid.identify(marked, langid.train(learn), keeps=["doc_id", "held_out"])


@register("op3_bpe")
def bpe_digests(spark, sf_dir):
    return bpe.digests(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@register("op6_simhash")
def simhash_components(spark, sf_dir):
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


DECONTAM_SQL = r"""
with d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w from documents),
i as (select cast(item_id as varchar) item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w from benchmark),
win as (select distinct item, least(len(w), 10) n, array_to_string(w[p:p + 9], ' ') g from (select item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) p from i where len(w) > 0)),
sizes as (select distinct n from win),
pos as (select doc_id, w, unnest(range(1, len(w) + 1)) p from d where len(w) > 0),
occ as (select doc_id, p, s.n, array_to_string(w[p:p + s.n - 1], ' ') g from pos, sizes s where p + s.n - 1 <= len(w)),
hit as (select doc_id, p, n, item from occ join win using (n, g)),
words as (select doc_id, count(distinct q) n_hit from (select doc_id, unnest(range(p, p + n)) q from hit) group by 1),
its as (select doc_id, count(*) n_items, string_agg(item, ',' order by item) ids from (select distinct doc_id, item from hit) group by 1)
select doc_id, cast(len(w) as bigint) n_words, coalesce(n_hit, 0) n_hit, coalesce(n_items, 0) n_items, sha256(coalesce(ids, '')) items_sha256, coalesce(n_hit, 0) > 0 contaminated
from d left join words using (doc_id) left join its using (doc_id)
"""


@register("op8_decontaminate", DECONTAM_SQL)
def benchmark_hits(spark, sf_dir):
    found = decontam.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


PII_SQL = r"""
with t as (select doc_id, coalesce(text, '') x from documents),
k(kind, nr, words) as (values ('email', 0, ''), ('ip', 1, ''), ('card', 2, ''), ('phone', 3, ''), ('iban', 4, ''), ('ssn', 5, 'ssn|social security')),
m as (select doc_id, kind, nr, words, case nr BY_KIND end f, case nr SPLIT_BY_KIND end p from t, k),
e as (select doc_id, kind, nr, words, p, unnest(f) v, unnest(range(1, len(f) + 1)) i, list_transform(f, lambda z: length(z)) fl, list_transform(p, lambda z: length(z)) pl from m where len(f) > 0),
s as (select doc_id, kind, nr, v, regexp_replace(v, '[^0-9]', '', 'g') d, replace(v, ' ', '') c, coalesce(list_sum(fl[1:i - 1]), 0) + list_sum(pl[1:i]) a,
  words, lower(right(p[i], 40) || ' ' || left(p[i + 1], 40)) near from e),
ok as (select *, a + length(v) z from s where case kind
  when 'ip' then list_bool_and(list_transform(string_split(v, '.'), lambda o: length(ltrim(o, '0')) <= 3 and cast('0' || right(ltrim(o, '0'), 3) as int) <= 255))
  when 'card' then LUHN
  when 'phone' then length(d) between 9 and 15
  when 'iban' then list_reduce(list_prepend(0, list_transform(string_split(substr(c, 5) || left(c, 4), ''), lambda o: case when o between '0' and '9' then cast(o as int) else ascii(o) - 55 end)), lambda g, o: (g * (case when o > 9 then 100 else 10 end) + o) % 97) = 1
  when 'ssn' then regexp_matches(near, words) else true end)
select doc_id, coalesce(n_email, 0) n_email, coalesce(n_ip, 0) n_ip, coalesce(n_card, 0) n_card, coalesce(n_phone, 0) n_phone, sha256(coalesce(base, '')) base_sha256, coalesce(spans, '') spans
from t left join (select doc_id, count(*) filter (kind = 'email') n_email, count(*) filter (kind = 'ip') n_ip, count(*) filter (kind = 'card') n_card, count(*) filter (kind = 'phone') n_phone,
  string_agg(concat(kind, ':', cast(a as bigint), ':', cast(z as bigint)), ',' order by nr, a) filter (nr < 4) base, string_agg(concat(kind, ':', cast(a as bigint), ':', cast(z as bigint)), ',' order by nr, a) spans from ok group by 1) using (doc_id)
"""
PATTERNS = (
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+", r"[0-9](?:[\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]",
    r"\b[A-Z]{2}[0-9]{2}(?:(?:\x20[A-Z0-9]{4}){2,7}(?:\x20[A-Z0-9]{1,3})?|[A-Z0-9]{11,30})\b", r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b",
)
PII_SQL = (
    PII_SQL.replace("SPLIT_BY_KIND", " ".join(f"when {i} then regexp_split_to_array(x, '{p}')" for i, p in enumerate(PATTERNS)))
    .replace("BY_KIND", " ".join(f"when {i} then regexp_extract_all(x, '{p}')" for i, p in enumerate(PATTERNS)))
    .replace("LUHN", "length(d) between 13 and 19 and list_sum([case when (length(d) - i) % 2 = 0 then cast(d[i] as int) when cast(d[i] as int) * 2 > 9 then cast(d[i] as int) * 2 - 9 else cast(d[i] as int) * 2 end for i in range(1, length(d) + 1)]) % 10 = 0")
)


@register("op5_pii", PII_SQL)
def personal_data(spark, sf_dir):
    found = pii.find(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
    base, every = [F.col(f"pii.{k}") for k in pii.BASE], [F.col(f"pii.{k.name}") for k in pii.KINDS]
    counts = [F.size(F.col(f"pii.{k}")).cast("long").alias(f"n_{k}") for k in pii.BASE]
    return found.select("doc_id", *counts, F.sha2(pii.listed(base).cast("binary"), 256).alias("base_sha256"), pii.listed(every).alias("spans"))


CHAT_SQL = r"""
with c as (select conv_id, turn, coalesce(role, '') r, coalesce(text, '') x from conversations
  union all select -7, 0, 'user', '</s>[INST] ok [/INST]' union all select -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
e as (select *, lag(r) over w p, length(replace(x, '\', '\\')) + len(regexp_extract_all(replace(replace(x, '\', '\\'), '<<', '<' || chr(1) || '<'), '[\[][/]?INST\]|\[INST:|\[TURN\]|</?s>|<\||<\x01<SYS>|<\x01</SYS>|</SYS>')) n,
  length(r) + 2 * len(regexp_extract_all(r, '[\[\]<%]')) m
  from c window w as (partition by conv_id order by turn, r, x))
select conv_id, count(*) n_turns, sha256(string_agg(r || chr(10) || x || chr(10), '' order by turn, r, x)) turns_sha256,
  coalesce(sum(length(x)) filter (r = 'assistant'), 0)::bigint loss_chars, sha256(coalesce(string_agg(x, '' order by turn, r, x) filter (r = 'assistant'), '')) loss_sha256,
  sum(n + case when p = r then 6 else 6 + m + 1 + 7 end)::bigint formatted_chars
from e group by 1
"""


@register("op4_chat", CHAT_SQL)
def chat(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    said = "</s>[INST] ok [/INST]"
    more = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    made = chat_format.format_conversations(rows.unionByName(more))
    read = made.select("conv_id", chat_format.read_back(F.col("formatted")).alias("turns"), chat_format.loss_text(F.col("segments")).alias("loss"), F.length("formatted").cast("long").alias("formatted_chars"))
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "")
    return read.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(lines.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"), "formatted_chars",
    )


QUALITY_SQL = r"""
with t as (select doc_id, coalesce(text, '') x from documents),
w as (select doc_id, x, regexp_extract_all(x, '[^\x20\x09-\x0D]+') w, list_filter(string_split(x, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) l from t),
g as (select doc_id, p, w[p] || ' ' || w[p + 1] || ' ' || w[p + 2] g from (select doc_id, w, unnest(range(1, len(w) - 1)) p from w)),
r as (select doc_id, count(distinct q) n from (select doc_id, unnest([p, p + 1, p + 2]) q from (select doc_id, p, count(*) over (partition by doc_id, g) c from g) where c > 1) group by 1),
o as (select doc_id, list_distinct(l) o, l, w, x from w),
k as (select doc_id, w, x, l, o, list_filter(o, lambda s: not (len(regexp_extract_all(s, '\|')) >= 2
    or regexp_matches(s, '(?i)^\s*(?:home|menu|login|log in|sign up|next|previous|read more|share|back to top|skip to content)\s*$')
    or len(regexp_extract_all(s || ' ', '(?:[#*$%&|<>]|[!?][!?])[\x20\x09-\x0D]')) > 0.3 * len(regexp_extract_all(s, '[^\x20\x09-\x0D]+'))
    or regexp_matches(s, '(?i)all rights reserved|cookie policy|privacy policy|terms of (?:use|service)|subscribe to|javascript (?:is )?(?:disabled|required)|powered by|click here'))) f from o),
b as (select doc_id, len(w) n_words, length(array_to_string(w, '')) word_chars, len(regexp_extract_all(x, '[#*$%&|<>]')) n_symbols, len(l) - len(o) n_dup_lines, coalesce(n, 0) n_repeat_words,
  length(array_to_string(f, '')) / nullif(length(array_to_string(l, '')), 0) left_share from k left join r using (doc_id))
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 or 100 * n_repeat_words > 50 * n_words base_failed,
  not (n_words < 50 or 100 * n_repeat_words > 50 * n_words) and coalesce(left_share, 0) >= 0.5 kept from b
"""


@register("op7_quality", QUALITY_SQL)
def quality_rules(spark, sf_dir):
    return quality.judge(table(spark, sf_dir, "documents"), keeps=["doc_id"]).drop("clean_text", "left_share")


#: Longest wins; the contract's rules.
URL_RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]


@register("op9_urls")
def url_verdicts(spark, sf_dir):
    return urls.judge(table(spark, sf_dir, "pages"), URL_RULES, keeps=["page_id"]).drop("score")


@register("op10_html")
def page_texts(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    found = html.extract(pages, html.train(pages), keeps=["page_id", "url"])
    return found.select("page_id", "url", F.col("main_text").alias("text"), F.length("main_text").cast("long").alias("n_chars"))


@register("op1_licenses")
def license_scan(spark, sf_dir):
    """Each document is a file in a directory of its source and language."""
    docs = table(spark, sf_dir, "documents")
    path = F.concat_ws("/", "source", "lang", F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    return licenses.scan(docs.select("doc_id", path.alias("path"), "text"))


SUBSTRINGS_SQL = r"""
with t as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') w from documents),
p as (select doc_id, unnest(range(1, len(w) - 11)) p, w from t where len(w) >= 13),
g as (select doc_id, p, sha256(array_to_string(w[p:p + 12], ' ')) g from p),
f as (select doc_id, p, min(doc_id) over (partition by g) first from g),
q as (select distinct doc_id, unnest(range(p, p + 13)) q from f where first < doc_id),
h as (select doc_id, list(q) q from q group by 1)
select doc_id, cast(len(w) as bigint) n_words, cast(coalesce(len(q), 0) as bigint) n_removed,
  sha256(array_to_string(case when q is null then w else list_filter(w, lambda x, i: not list_contains(q, i)) end, ' ')) kept_sha256
from t left join h using (doc_id)
"""


@register("op11_substrings", SUBSTRINGS_SQL)
def repeated_substrings(spark, sf_dir):
    return substrings.digests(table(spark, sf_dir, "documents").select("doc_id", "text"))


NEGATIVES_SQL = """
with e as (select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end g, list_transform(embedding, lambda c: floor(256 * cast(c as double))) x from embeddings
  where vec_id is not null and label is not null and embedding is not null and len(list_filter(embedding, lambda c: c is null or not isfinite(c))) = 0),
s as (select a.vec_id anchor_id, b.vec_id other, a.g = b.g same, cast(list_inner_product(a.x, b.x) as bigint) score from e a, e b where a.vec_id % 100 = 0 and a.vec_id <> b.vec_id),
p as (select anchor_id, other positive_id, score positive_score from s where same qualify row_number() over (partition by anchor_id order by score desc, other) <= 5)
select anchor_id, positive_id, cast(row_number() over w as integer) as rank, other negative_id, positive_score, score negative_score from p join s using (anchor_id)
where not same and 30 * positive_score <= 100 * score and 100 * score <= 90 * positive_score
window w as (partition by anchor_id, positive_id order by score desc, other) qualify row_number() over w <= 10
"""


@register("op12_negatives", NEGATIVES_SQL)
def hard_negatives(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").where(vectors.usable("embedding"))
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    given = rows.select("vec_id", moved.alias("label"), vectors.whole("embedding", 256).alias("embedding"))
    return negatives.mine(given, lambda key: key % 100 == 0)


@register("op13_whitening")
def whitened_vectors(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    model = whitening.fit(rows)
    share = F.lit(model.explained.tolist()).cast("array<double>")
    found = whitening.transform(rows, model, ["vec_id"]).select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return found.select(
        "vec_id", (F.col("at") + 1).cast("int").alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened",
        F.get(share, F.col("at")).alias("explained"), F.lit(model.identity_error).cast("double").alias("identity_error"),
    )
