"""Registered queries of the corpus operators, each with its reference SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline.llm import alignment, ann, bpe, divergence, line_dedup, near_dedup, packing, quality, token_files, topk, toxicity, url_filter, warc

#: Where every executor has the public vocabulary.
VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
BYTE_VOCABULARY, PIECE_VOCABULARY = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")

Build = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Build] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Build], Build]:
    def register(build: Build) -> Build:
        QUERIES[name] = build
        if sql is not None:
            ORACLES[name] = sql
        return build

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op1_quality_classifier")
def _op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents")).select("doc_id", "quality_score", "quality_keep")


@query("op2_ann")
def _op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return ann.search(vectors, vectors.filter("vec_id % 20 = 0"), k=20)


@query("op3_line_dedup", """
with split as (select doc_id, string_split(coalesce(text, ''), chr(10)) as l from documents),
lines as (select doc_id, unnest(l) as line, unnest(range(1, len(l) + 1)) as pos from split),
keys as (select *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
  'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key from lines),
shared as (select key, max(doc_id) as keeper from keys where length(key) >= 20 group by key having count(distinct doc_id) >= 3),
marked as (select k.*, coalesce(k.doc_id <> s.keeper, false) as gone from keys k left join shared s using (key))
select doc_id, count(*) as n_lines, count(*) filter (where gone) as n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by pos) filter (where not gone), '')) as kept_sha256
from marked group by doc_id""")
def _op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.line_dedup(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


@query("op4_token_counts")
def _op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_counts(table(spark, sf_dir, "documents"), VOCABULARY, separator=49407).select("doc_id", "n_tokens")


@query("op5_near_dedup")
def _op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.classes(table(spark, sf_dir, "documents"))


@query("op6_packing")
def _op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary=VOCABULARY).drop("ids")


@query("op7_bpe")
def _op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), VOCABULARY, decoded=True)
    return coded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join("ids", " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


URL_RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]


@query("op8_url_filter")
def _op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.url_filter(table(spark, sf_dir, "pages"), URL_RULES)


@query("op9_exact_topk", """
with v as (select distinct vec_id, [cast(floor(256 * cast(x as double)) as bigint) for x in embedding] as q from embeddings
  where vec_id is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
scored as (select a.vec_id as query_id, b.vec_id, cast(list_sum([x * b.q[i] for x, i in a.q]) as bigint) as score
  from v a join v b on a.vec_id <> b.vec_id where a.vec_id % 50 = 0),
ranked as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from scored)
select query_id, cast(rank as integer) as rank, vec_id, score from ranked where rank <= 5""")
def _op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return topk.top_k(vectors, vectors.filter("vec_id % 50 = 0"), k=5)


@query("op10_warc")
def _op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc.archive(table(spark, sf_dir, "pages"), min_bytes=0)
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "digest_ok")


@query("op11_source_divergence", r"""
with d as (select row_number() over () as row_id, coalesce(lang, '') as lang, coalesce(source, '') as source, coalesce(text, '') as text from documents),
tok as (select row_id, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) as term from d),
kept as (select lang, term, count(*) as total from tok group by lang, term having count(distinct row_id) >= 3),
sized as (select lang, count(*) as v, sum(total) as n_lang from kept group by lang),
counted as (select lang, source, term, count(*) as c from tok group by lang, source, term),
grouped as (select distinct lang, source from d),
dense as (select g.lang, g.source, k.term, coalesce(c.c, 0) as c, k.total from grouped g join kept k using (lang) left join counted c using (lang, source, term)),
shares as (select lang, source, term, c, 1 + (1000000000::hugeint * (c + 1)) // (sum(c) over (partition by lang, source) + s.v)::hugeint as p,
  1 + (1000000000::hugeint * (total + 1)) // (s.n_lang + s.v)::hugeint as q from dense join sized s using (lang)),
pair as (select g.lang, g.source, 'pair' as part, o.source as item, coalesce(t.value, 0) as value from grouped g join grouped o on g.lang = o.lang and g.source <> o.source
  left join (select a.lang, a.source, b.source as item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) as value from shares a join shares b
    on a.lang = b.lang and a.term = b.term and a.source <> b.source group by a.lang, a.source, b.source) t on t.lang = g.lang and t.source = g.source and t.item = o.source),
own as (select lang, source, 'term' as part, term as item, ((p - q) * (p - q)) // q as value from shares where c > 0 and p > q),
ranked as (select *, row_number() over (partition by lang, source, part order by value desc, item) as rank from (select * from pair union all select * from own))
select lang, source, part, item, cast(value as bigint) as value, cast(rank as integer) as rank from ranked where part = 'pair' or rank <= 200""")
def _op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergence(table(spark, sf_dir, "documents"))


@query("op12_toxicity")
def _op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", "held_out", "score", "predicted")


@query("op13_tokenizer_alignment")
def _op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    aligned = alignment.align(table(spark, sf_dir, "documents"), BYTE_VOCABULARY, PIECE_VOCABULARY)
    spelled = F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256)).alias("groups_sha256")
    return aligned.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", spelled)
