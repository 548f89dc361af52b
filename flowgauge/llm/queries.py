"""One query for each operator, with its SQL where SQL can state it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from flowgauge.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def register(function):
        QUERIES[name] = function
        if oracle is not None:
            ORACLES[name] = oracle.strip()
        return function

    return register


MINHASH_SQL = r"""
with recursive words as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w
  from documents),
shingles as (
  select doc_id, unnest(list_distinct(case when len(w) = 0 then []
    when len(w) < 4 then [array_to_string(w, ' ')]
    else list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i+3], ' ')) end)) as s from words),
sizes as (select doc_id, count(*) as n from shingles group by doc_id),
pairs as (
  select a.doc_id as u, b.doc_id as v, count(*) as common
  from shingles a join shingles b on a.s = b.s and a.doc_id <> b.doc_id group by all),
links as (
  select u, v from pairs join sizes x on u = x.doc_id join sizes y on v = y.doc_id
  where 100 * common >= 80 * (x.n + y.n - common)),
reach as (select u, v from links union select r.u, l.v from reach r join links l on r.v = l.u),
least as (select u, min(v) as v from reach group by u)
select d.doc_id, cast(coalesce(n, 0) as bigint) as n_shingles,
       least(d.doc_id, coalesce(least.v, d.doc_id)) as component_id,
       d.doc_id = least(d.doc_id, coalesce(least.v, d.doc_id)) as kept
from documents d left join sizes using (doc_id) left join least on d.doc_id = least.u
"""


@query("op1_minhash", MINHASH_SQL)
def minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from flowgauge.llm.minhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


@query("op8_arrow_sequences")
def arrow_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from flowgauge.llm.arrowtokens import read_documents, write_sequences

    manifest = write_sequences(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return read_documents(spark, manifest)


@query("op9_tree_bpe")
def tree_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from flowgauge.llm.bpe import digests

    return digests(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query("op10_rendezvous")
def rendezvous(spark: SparkSession, sf_dir: str) -> DataFrame:
    from flowgauge.llm.sharding import assign

    return assign(table(spark, sf_dir, "documents"))


@query("op4_best_fit")
def best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from flowgauge.llm.packing import packed_documents

    return packed_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query("op5_warc")
def warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from flowgauge.llm.warc import captures

    return captures(table(spark, sf_dir, "pages"))


MAXSCORE_SQL = """
with v as (select distinct vec_id, list_transform(embedding, lambda x: floor(1024 * cast(x as double))) as v
  from embeddings where vec_id is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
scores as (
  select q.vec_id as query_id, c.vec_id, cast(list_dot_product(q.v, c.v) as bigint) as score
  from v q join v c on q.vec_id <> c.vec_id where q.vec_id % 100 = 0),
ranked as (select *, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank from scores)
select query_id, rank, vec_id, score from ranked where rank <= 10
"""


@query("op2_maxscore", MAXSCORE_SQL)
def maxscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    from flowgauge.llm.maxscore import integer_vectors, top_k

    vectors = integer_vectors(table(spark, sf_dir, "embeddings"))
    return top_k(vectors, vectors.where("vec_id % 100 = 0"))


@query("op6_credential_links")
def credential_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    from flowgauge.llm.secrets import digests

    return digests(table(spark, sf_dir, "documents"))


@query("op3_outliers")
def outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    from flowgauge.llm.quality import judged

    return judged(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance")


@query("op7_counterfactual")
def counterfactual(spark: SparkSession, sf_dir: str) -> DataFrame:
    from flowgauge.llm.toxicity import classified

    return classified(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


HOSTS_SQL = r"""
with rest as (
  select page_id, case when instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) else '' end as r from pages),
parts as (
  select page_id, translate(regexp_extract(r, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
         regexp_extract(r, '^[^/?#]*([^?#]*)', 1) as path from rest),
bad as (
  select doc_id as id, max(greatest(cast(quality = 0 as integer), cast(toxic = 1 as integer))) as bad from labels
  where doc_id is not null and coalesce(quality, toxic) is not null group by doc_id),
counts as (
  select host, regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', '') as bare,
         count(bad) as n, cast(coalesce(sum(bad), 0) as bigint) as k
  from parts left join bad on page_id = id group by host),
names as (select *, string_split(bare, '.') as w, regexp_matches(bare, '^[0-9.]+$') or bare[1] = '[' as address from counts),
named as (
  select *, case when array_to_string(w[greatest(len(w) - 1, 1):], '.') in ('ac.uk', 'co.jp', 'co.uk', 'com.au', 'com.br', 'org.uk')
                 then 2 else 1 end as width from names),
hosts as (
  select host, n, k, case when address then '' else array_to_string(w[greatest(len(w) - width + 1, 1):], '.') end as suffix,
         case when address then bare else array_to_string(w[greatest(len(w) - width, 1):], '.') end as domain from named),
suffixes as (select suffix, cast(sum(n) as bigint) as n, cast(sum(k) as bigint) as k from hosts group by suffix),
domains as (select domain, suffix, cast(sum(n) as bigint) as n, cast(sum(k) as bigint) as k from hosts group by domain, suffix),
groups as (
  select 1 as level, '' as parent, n, k from suffixes
  union all select 2, suffix, n, k from domains
  union all select 3, domain, n, k from hosts),
parents as (
  select level, parent, cast(sum(n) as double) as n, cast(sum(k) as double) as k, cast(sum(n * n) as double) as nn
  from groups group by level, parent),
own as (
  select level, cast(count(*) as double) as m, cast(sum(n) as double) as n, cast(sum(k) as double) as k,
         cast(sum(cast(round(1e6 * k * k / n) as bigint)) as double) as s from groups where n > 0 group by level),
over as (
  select level, cast(count(*) as double) as m, cast(sum(cast(round(1e6 * k * k / n) as bigint)) as double) as s,
         cast(sum(cast(round(1e6 * nn / n) as bigint)) as double) as nn from parents where n > 0 group by level),
moments as (
  select level, (own.k / own.n) * (1 - own.k / own.n) as chance, own.m - over.m as free, own.n as n,
         own.s - over.s as s, over.nn / 1e6 as nn from own join over using (level)),
scatters as (
  select level, case when chance * (n - nn - free) > 0 then (s / 1e6 - free * chance) / (chance * (n - nn - free)) end as scatter from moments),
priors as (
  select level, case when scatter is null or scatter <= 1 / (10000.0::double + 1) then 10000.0::double
                     else greatest(1.0::double, 1 / scatter - 1) end as m from scatters),
prior as (
  select coalesce(max(m) filter (level = 1), 10000.0::double) as m1, coalesce(max(m) filter (level = 2), 10000.0::double) as m2,
         coalesce(max(m) filter (level = 3), 10000.0::double) as m3 from priors),
whole as (select (coalesce(sum(k), 0) + 0.5::double) / (coalesce(sum(n), 0) + 1.0::double) as p from hosts),
s1 as (select suffix, (k + m1 * p) / (n + m1) as p from suffixes, prior, whole),
s2 as (select domain, (k + m2 * p) / (n + m2) as p from domains join s1 using (suffix), prior),
s3 as (select host, k + m3 * p as a, n - k + m3 * (1 - p) as b from hosts join s2 using (domain), prior),
blocked as (
  select host from s3 where a / (a + b) - 1.645::double * sqrt((a / (a + b)) * (1 - a / (a + b)) / (a + b + 1)) > 0.5::double),
ruled as (
  select page_id, host, path, case
    when (host = 'www.example.com' or ends_with(host, '.www.example.com')) and starts_with(path, '/en/') then 'www.example.com/en/'
    when (host = 'example.com' or ends_with(host, '.example.com')) and starts_with(path, '/en/') then 'example.com/en/'
    when (host = 'net' or ends_with(host, '.net')) and starts_with(path, '/es/') then 'net/es/'
    when (host = 'net' or ends_with(host, '.net')) and starts_with(path, '/fr/') then 'net/fr/'
    when (host = 'com' or ends_with(host, '.com')) and starts_with(path, '/') then 'com/' end as rule from parts)
select page_id, host, path, rule, case
    when rule in ('www.example.com/en/', 'com/') then 'allow' when rule is not null then 'block'
    when host in (select host from blocked) then 'block' else 'allow' end as verdict
from ruled
"""


@query("op12_host_reputation", HOSTS_SQL)
def host_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    from flowgauge.llm.hosts import judged

    return judged(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))


@query("op13_periodic_runs")
def periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from flowgauge.llm.runs import digests

    return digests(table(spark, sf_dir, "documents"))


@query("op11_token_alignment")
def token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from flowgauge.llm.align import linked

    return linked(table(spark, sf_dir, "documents"), *map(public_tokenizers.path, ("byte_bpe_50k.json", "piece_bpe_32k.model")))
