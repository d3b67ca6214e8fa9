"""The registered query of each corpus operator, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from acutance.llm import balltree, chat, collocations, exact, lexical, licenses, mixing, ngrams, pieces, quality, simhash, suffixes, urls
from acutance.session import read_table


def model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mixing.mix(read_table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return found.select("doc_id", "size", "source_size", "target", "taken")


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    weights = quality.train_from_labels(docs, read_table(spark, sf_dir, "labels"))
    held = quality.fold(F.col("doc_id"), 3) == 1
    return quality.score(docs, weights).select("doc_id", held.alias("held_out"), "score", "predicted")


def op3_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex16().alias("fingerprint"), "component_id")


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact.exact_groups(read_table(spark, sf_dir, "documents"))
    return found.select(F.col("key").alias("doc_id"), F.col("keep_key").alias("keep_id"), "group_size", "kept", F.col("digest").alias("text_sha256"))


OP4_SQL = r"""
with t as (select doc_id, length(coalesce(text, '')) n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') norm from documents),
r as (select *, row_number() over (partition by norm order by n desc, doc_id) k, count(*) over (partition by norm) group_size,
  first_value(doc_id) over (partition by norm order by n desc, doc_id) keep_id from t)
select doc_id, keep_id, group_size, k = 1 as kept, sha256(norm) as text_sha256 from r
"""


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return pieces.encode_decode(docs, model_path()).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(read_table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


OP9_SQL = r"""
with u as (select page_id, coalesce(url, '') url from pages),
h as (select page_id, url, case when contains(url, '://') then substr(url, strpos(url, '://') + 3) else '' end rest from u),
p as (select page_id, url, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) path from h),
r as (select *, case
    when (host = 'example.com' or host like '%.example.com') and path like '/de/%' then 'example.com/de/'
    when (host = 'example.net' or host like '%.example.net') and path like '/en/%' then 'example.net/en/'
    when (host = 'org' or host like '%.org') and path like '/fr/%' then 'org/fr/'
    when (host = 'net' or host like '%.net') and path like '/%' then 'net/' end as rule,
  regexp_replace(regexp_replace(lower(url), '[0-9]', '0', 'g'), '[^a-z0./:-]', '_', 'g') t from p),
t as (select t, count(*) filter (rule in ('example.net/en/', 'org/fr/')) a, count(*) filter (rule in ('net/', 'example.com/de/')) r from r group by t),
e as (select t, a, r, substr('^^^' || t, i, 4) g from t, unnest(range(1, length(t) + 1)) x(i) where length(t) > 0),
c as (select g, sum(a) a, sum(r) r from e group by g),
c0 as (select substr(g, 4, 1) k, sum(a) a, sum(r) r from c group by 1),
c1 as (select substr(g, 3, 2) k, sum(a) a, sum(r) r from c group by 1),
c2 as (select substr(g, 2, 3) k, sum(a) a, sum(r) r from c group by 1),
x0 as (select sum(a) a, sum(r) r from c),
x1 as (select substr(k, 1, 1) k, sum(a) a, sum(r) r from c1 group by 1),
x2 as (select substr(k, 1, 2) k, sum(a) a, sum(r) r from c2 group by 1),
x3 as (select substr(g, 1, 3) k, sum(a) a, sum(r) r from c group by 1),
m as (select c.g,
    (c.a + 4.0e0*(c2.a + 4.0e0*(c1.a + 4.0e0*(c0.a + 4.0e0/32)/(x0.a + 4.0e0))/(x1.a + 4.0e0))/(x2.a + 4.0e0))/(x3.a + 4.0e0) pa,
    (c.r + 4.0e0*(c2.r + 4.0e0*(c1.r + 4.0e0*(c0.r + 4.0e0/32)/(x0.r + 4.0e0))/(x1.r + 4.0e0))/(x2.r + 4.0e0))/(x3.r + 4.0e0) pr
  from c join c0 on c0.k = substr(c.g, 4, 1) join c1 on c1.k = substr(c.g, 3, 2) join c2 on c2.k = substr(c.g, 2, 3)
  cross join x0 join x1 on x1.k = substr(c.g, 3, 1) join x2 on x2.k = substr(c.g, 2, 2) join x3 on x3.k = substr(c.g, 1, 3)),
s as (select t, any_value(a) a, any_value(r) r, avg(log10(pa) - log10(pr)) s from e join m using (g) group by t),
th as (select (sum(s*a)/nullif(sum(a), 0) + sum(s*r)/nullif(sum(r), 0))/2 th from s)
select page_id, host, path, rule, case when rule in ('example.net/en/', 'org/fr/') then 'allow' when rule is not null then 'block'
  when coalesce(round(coalesce(s, 0), 9) >= round(th, 9), true) then 'allow' else 'block' end verdict
from r left join s using (t) cross join th
"""


def op6_chat_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = chat.rotate(read_table(spark, sf_dir, "conversations"))
    spans = F.expr("array_join(transform(mask, m -> concat(m.start, '-', m.end)), ',')")
    said = F.expr("aggregate(mask, 0L, (n, m) -> n + m.end - m.start)")
    return found.select("conv_id", "speaker", "part", "n_turns", F.length("rendered").cast("long").alias("n_chars"), said.alias("masked_chars"), F.sha2("rendered", 256).alias("text_sha256"), F.sha2(spans, 256).alias("mask_sha256"))


OP6_SQL = r"""
with r as (select conv_id c, turn t, coalesce(role, 'unknown') r, coalesce(text, '') x, cast(coalesce(floor(turn / 256), 0) as bigint) part from conversations),
s as (select distinct c, r speaker from r where r <> 'system'),
j as (select r.*, s.speaker, r.r = s.speaker as own, case when r.r = 'system' then '<|system|>' || chr(10) when r.r = s.speaker then '<|assistant|>' || chr(10) else '<|user|>' || r.r || chr(10) end h
  from r join s on r.c is not distinct from s.c),
o as (select *, coalesce(sum(length(h) + length(x) + 8) over (partition by c, speaker, part order by t nulls first, r, x, h, own rows between unbounded preceding and 1 preceding), 0) b from j),
g as (select c, speaker, part, count(*) n, sum(length(h) + length(x) + 8) n_chars, coalesce(sum(length(x) + 7) filter (own), 0) masked,
  string_agg(h || x || '<|end|>' || chr(10), '' order by t nulls first, r, x, h, own) txt,
  coalesce(string_agg(cast(b + length(h) as bigint) || '-' || cast(b + length(h) + length(x) + 7 as bigint), ',' order by b) filter (own), '') spans
  from o group by c, speaker, part)
select c as conv_id, speaker, part, n as n_turns, cast(n_chars as bigint) n_chars, cast(masked as bigint) masked_chars, sha256(txt) text_sha256, sha256(spans) mask_sha256 from g
"""


def op5_top_k_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return balltree.top_k(read_table(spark, sf_dir, "embeddings"))


OP5_SQL = r"""
with v as (select vec_id id, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) v from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0),
e as (select id, unnest(v) x, generate_subscripts(v, 1) i from v),
s as (select q.id query_id, c.id vec_id, sum(q.x * c.x) score from e q join e c on q.i = c.i and q.id <> c.id where q.id % 50 = 0 group by 1, 2),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id) rank from s)
select query_id, cast(rank as integer) as rank, vec_id, cast(score as bigint) score from r where rank <= 5
"""


def op8_repeated_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.digest_columns(suffixes.repeats(read_table(spark, sf_dir, "documents")))


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngrams.score(read_table(spark, sf_dir, "documents"))


def op13_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(read_table(spark, sf_dir, "documents").select("lang", "text"))


OP13_SQL = r"""
with p as (select coalesce(lang, 'und') lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) piece from documents),
w as (select lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') ws from p),
o as (select lang, ws, unnest(range(1, len(ws) + 1)) i from w),
g as (select lang, k, list_slice(ws, i, i + k - 1) ph from o, (values (1), (2), (3)) t(k) where i + k - 1 <= len(ws)),
c as (select lang, k, ph, cast(count(*) as hugeint) f from g group by all),
n as (select lang, sum(f) n from c where k = 1 group by 1),
cand as (select * from c where k > 1 and f >= 10),
inside as (select lang, q, max(f) most from (select lang, ph[1:2] q, f from cand where k = 3 union all select lang, ph[2:3], f from cand where k = 3) group by 1, 2),
kept as (select cand.* from cand left join inside on cand.lang = inside.lang and cand.ph = inside.q and cand.k = 2 where not coalesce(100 * most >= 50 * f, false)),
cut as (select kept.lang, kept.ph, kept.f a, j, x.f l, y.f r, 1000000 * kept.f * kept.f // (x.f * y.f) score
  from kept join (values (1), (2)) t(j) on j < kept.k join c x on x.lang = kept.lang and x.ph = kept.ph[1:j] join c y on y.lang = kept.lang and y.ph = kept.ph[j + 1:kept.k]),
best as (select * from cut qualify row_number() over (partition by lang, ph order by score, j) = 1),
r as (select lang, row_number() over (partition by lang order by score desc, a desc, array_to_string(ph, ' ')) rank, array_to_string(ph, ' ') phrase, a, l, r, score from best)
select r.lang, rank, phrase, cast(a as bigint) a, cast(l as bigint) l, cast(r as bigint) r, cast(n as bigint) n, cast(score as bigint) score from r join n using (lang) where rank <= 2000
"""


def op12_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(read_table(spark, sf_dir, "documents")).drop("matches")


OP12_SQL = licenses.places_sql()


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


OP11_SQL = r"""
with words as (select 'd' kind, doc_id id, row_number() over () r, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') ws from documents where text is not null
  union all select 'q', item_id, row_number() over (), regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') from benchmark where text is not null),
d as (select r, id doc_id, len(ws) n, ws from words where kind = 'd' and len(ws) > 0),
c as (select count(*) nn, cast(sum(n) as bigint) ll from d),
tf as (select r, t, count(*) tf from (select r, unnest(ws) t from d) group by all),
w as (select t, cast(floor(1000 * ln((2 * nn + 2) / (2 * df + 1))) as bigint) w from (select t, count(*) df from tf group by t) cross join c),
q as (select distinct r qr, id item_id, t from (select r, id, unnest(ws) t from words where kind = 'q')),
m as (select r, doc_id, 50 + ((50 * n * nn) // ll) m from d cross join c),
s as (select q.qr, q.item_id, m.r, m.doc_id, cast(sum(w.w * ((1000000000 * tf.tf) // (1000 * tf.tf + 20 * m.m))) as bigint) score from q join w using (t) join tf using (t) join m on m.r = tf.r group by all),
k as (select *, row_number() over (partition by qr order by score desc, doc_id) rank from s where score > 0)
select item_id, cast(rank as integer) rank, doc_id, score from k where rank <= 50
"""
