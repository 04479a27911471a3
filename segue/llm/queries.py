"""One registered query per operator, over its whole table, and SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from segue.llm import decontam, lm, metric_join, packing, prefix_trie, quality, secrets, sharding, simhash, spelling, substring, toxicity, urls
from segue.llm.sqltext import crc32

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(name: str, oracle: str | None = None):
    def wrap(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = fn
        if oracle:
            ORACLES[name] = oracle
        return fn

    return wrap


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@_query("op1_url_filter", """
with u as (
  select page_id, coalesce(url, '') as url from pages
), h as (
  select page_id, translate(regexp_extract(url, '://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
         regexp_extract(url, '://([^/?#]*)([^?#]*)', 2) as path
  from u
), r(rhost, rpath, rverdict) as (
  values ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')
), s as (
  select h.*, (select arg_max(rhost || rpath, length(rhost || rpath)) from r where ends_with('.' || host, '.' || rhost) and starts_with(path, rpath)) as rule
  from h
)
select page_id, host, path, rule, coalesce(
  (select rverdict from r where rhost || rpath = rule),
  case when regexp_matches(host || path, 'casino-win|cheap-pills|free-bets|/wp-login') or ends_with(host || path, '.exe') or ends_with(host || path, '.zip') then 'block' else 'allow' end
) as verdict
from s
""")
def url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(_table(spark, sf_dir, "pages"))


@_query("op2_lm_score")
def lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.judge(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


@_query("op3_packing")
def packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), tokenizer_file())


@_query("op4_decontamination")
def contaminated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


@_query("op5_quality")
def quality_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


@_query("op6_secret_scan")
def secret_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find(_table(spark, sf_dir, "documents"))


@_query("op7_metric_join", """
with recursive v as (
  select vec_id, label, list_transform(embedding, lambda x: x::double) as e from embeddings
), u as (
  select vec_id, label, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) as norm
  from v where vec_id is not null and label is not null and len(e) > 0 and len(list_filter(e, lambda x: x is null or not isfinite(x))) = 0
), l as (
  select a.vec_id as a, b.vec_id as b from u a join u b on a.label = b.label and a.vec_id <> b.vec_id and len(a.e) = len(b.e)
  where a.norm > 0 and b.norm > 0 and list_dot_product(a.e, b.e) / (a.norm * b.norm) >= 0.98
), reach(a, b) as (
  select a, b from l union select r.a, l.b from reach r join l on r.b = l.a
), n as (
  select a, count(*) as n_links from l group by a
), c as (
  select a, min(b) as low from reach group by a
)
select v.vec_id, coalesce(n.n_links, 0) as n_links, least(v.vec_id, coalesce(c.low, v.vec_id)) as component_id,
       v.vec_id = least(v.vec_id, coalesce(c.low, v.vec_id)) as kept
from v left join n on n.a = v.vec_id left join c on c.a = v.vec_id
""")
def near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metric_join.near_vectors(_table(spark, sf_dir, "embeddings"))


@_query("op8_toxicity")
def toxicity_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.judge(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


@_query("op9_simhash")
def simhash_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


@_query("op10_substring_dedup", r"""
with w as (
  select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as ws from documents
), g as (
  select doc_id, ws, unnest(range(1, len(ws) - 11)) as i from w where len(ws) >= 13
), k as (
  select doc_id, i, array_to_string(ws[i:i + 12], ' ') as s from g
), m as (
  select s, min(doc_id) as low from k group by s
), gone as (
  select distinct doc_id, unnest(range(i, i + 13)) as j from k join m using (s) where low < doc_id
), a as (
  select doc_id, unnest(ws) as word, unnest(range(1, len(ws) + 1)) as j from w
), kept as (
  select a.doc_id, count(gone.j) as n_removed, string_agg(a.word, ' ' order by a.j) filter (where gone.j is null) as t
  from a left join gone on a.doc_id = gone.doc_id and a.j = gone.j group by a.doc_id
)
select w.doc_id, len(w.ws) as n_words, coalesce(n_removed, 0) as n_removed, sha256(coalesce(t, '')) as kept_sha256
from w left join kept on w.doc_id = kept.doc_id
""")
def substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.without_repeats(_table(spark, sf_dir, "documents"), with_text=False).drop("kept")


@_query("op11_prefix_trie", rf"""
with t as (
  select conv_id, md5(md5(coalesce(role, '')) || md5(coalesce(text, ''))) as k, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as w, turn
  from conversations where conv_id is not null
), o as (
  select conv_id, k, w, row_number() over (partition by conv_id order by turn nulls first, k) - 1 as nth from t
), c as (
  select conv_id, {crc32("cast(conv_id as varchar)")} % 4 as h, conv_id - conv_id % 20 as base from (select distinct conv_id from o)
), r as (
  select c.conv_id, 0 as part, nth, k, w from c join o on o.conv_id = c.base and nth < h
  union all select c.conv_id, 1, nth, k, w from c join o on o.conv_id = c.conv_id and nth >= h
), s as (
  select c.conv_id, coalesce(list(k order by part, nth) filter (where k is not null), []) as ks, coalesce(list(w order by part, nth) filter (where k is not null), []) as ws
  from c left join r using (conv_id) group by c.conv_id
), m as (
  select conv_id, ks, ws, d, array_to_string(ks[1:d], ',') as path from (select conv_id, ks, ws, unnest(range(len(ks) + 1)) as d from s)
), n as (
  select d, path, min(conv_id) as low, count(*) as n_convs, coalesce(any_value(ws[d]) filter (where d > 0), 0) as w,
         string_agg(cast(conv_id as varchar), ',' order by conv_id) filter (where len(ks) = d) as ends
  from m group by d, path
), kids as (
  select d - 1 as d, array_to_string(string_split(path, ',')[1:d - 1], ',') as path, count(*) as n_children from n where d > 0 group by all
), v as (
  select n.*, coalesce(n_children, 0) as n_children from n left join kids using (d, path)
), up as (
  select d, array_to_string(ks[1:d], ',') as path, sum(case when n_children = 0 then 1 else 0 end) as n_leaves, sum((n_convs - 1) * w) as saved_tokens
  from (select n_children, n_convs, w, ks, unnest(range(v.d + 1)) as d from v join s on s.conv_id = v.low) group by all
)
select v.low as conv_id, v.d as depth, p.low as parent_conv_id, v.n_convs, v.n_children, cast(n_leaves as bigint) as n_leaves,
       cast(saved_tokens as bigint) as saved_tokens, sha256(coalesce(v.ends, '')) as ends_sha256
from v join up using (d, path) left join v p on p.d = v.d - 1 and p.path = array_to_string(string_split(v.path, ',')[1:v.d - 1], ',')
""")
def conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(_table(spark, sf_dir, "conversations"))


@_query("op12_sharding", f"""
with recursive d as (
  select doc_id, coalesce(text, '') as text from documents
), z as (
  select doc_id, ('0x' || substr(md5(text), 1, 15))::bigint as key, cast(octet_length(encode(text)) + 16 as bigint) as size, {crc32("text")} as text_crc32 from d
), g as (
  select key, cast(sum(size) as bigint) as bytes from z group by key
), o as (
  select key, bytes, row_number() over w - 1 as nth, (select sum(bytes) from g) - sum(bytes) over w + bytes as remains from g window w as (order by bytes desc, key)
), heavy as (
  select key, nth from o where nth < 40 and nth < coalesce((select min(nth) from o where bytes * (40 - nth) <= remains), 40)
), k as (
  select 40 - count(*) as shards from heavy
), line as (
  select key, bytes, cast(sum(bytes) over (order by key) as bigint) as stop from g where key not in (select key from heavy)
), marks as (
  select 0::bigint as stop union all select stop from line
), whole as (
  select max(stop) as total, (select max(bytes) from line) as largest from line
), search(low, high, here, cuts) as (
  select cast(greatest(largest, ceil(total / (select shards from k))) as bigint), total, 0::bigint, 0 from whole where total is not null
  union all
  select case when top < total and cuts + 1 >= shards then (low + high) // 2 + 1 else low end, case when top = total then (low + high) // 2 else high end,
         case when top = total or cuts + 1 >= shards then 0 else top end, case when top = total or cuts + 1 >= shards then 0 else cuts + 1 end
  from (select low, high, cuts, max(stop) as top from search join marks on stop <= here + (low + high) // 2 where low < high group by all) x, whole, k
), best as (
  select min(high) as capacity from search where low = high
), cut(nth, here) as (
  select 0, 0::bigint
  union all
  select nth + 1, max(stop) from cut join marks on stop <= here + (select capacity from best) where here < (select total from whole) group by nth
), placed as (
  select key, (select count(*) from heavy) + (select count(*) from cut where nth > 0 and here <= stop - bytes) as shard from line
  union all select key, nth from heavy
)
select doc_id, size, text_crc32, 'bytes' as law, cast(shard as integer) as shard,
       row_number() over (partition by shard order by key, doc_id nulls first) - 1 as slot, cast(null as integer) as grown_shard
from z join placed using (key)
""")
def sharded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.sharded(_table(spark, sf_dir, "documents"))


#: Each letter from U+00C0 to U+00FF as a sign of one byte, for a function that counts bytes.
_ACCENTS = "".join(map(chr, range(0xC0, 0x100)))
_SIGNS = "".join(c for c in map(chr, range(33, 127)) if not c.islower() and c != "'")[:64]


@_query("op13_spelling", f"""
with recursive r as (
  select coalesce(cast(doc_id as varchar), '') || ':' as id, unnest(regexp_extract_all(text, '[A-Za-z\\x{{00C0}}-\\x{{00FF}}]+')) as run from documents
), l as (
  select id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as w from r where length(run) >= 5
), d as (
  select id, w, count(*) as times from l group by id, w
), h as (
  select w, times, {crc32("id || w")} as h from d
), u as (
  select case when h % 97 = 0 then substr(w, 1, h % length(w)) || substr(w, h % length(w) + 2) else w end as word, times from h
), v as (
  select word, cast(sum(times) as bigint) as n, length(word) as len, translate(word, '{_ACCENTS}', '{_SIGNS}') as signs
  from u where length(word) >= 5 group by word having sum(times) >= 3
), p as (
  select a.word, a.n, b.word as other, b.n as m
  from v a join v b on b.len between a.len - 1 and a.len + 1 and a.word <> b.word and levenshtein(a.signs, b.signs) = 1
), f as (
  select word, count(*) as n_near, max(m) as m, min(other) filter (where m = top) as other
  from (select *, max(m) over (partition by word) as top from p) group by word
), e as (
  select v.word, v.n, coalesce(n_near, 0) as n_near, case when m >= 2 * v.n then other end as form, case when m >= 2 * v.n then m end as form_n
  from v left join f on f.word = v.word
), s(word, here) as (
  select word, word from e union all select s.word, e.form from s join e on e.word = s.here where e.form is not null
), q as (
  select s.word, s.here as root from s join e on e.word = s.here where e.form is null
)
select e.word, form, root, n, n_near, form_n from e join q on q.word = e.word
""")
def spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(_table(spark, sf_dir, "documents"))
