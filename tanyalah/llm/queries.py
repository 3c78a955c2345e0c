"""The registered queries of the operators, over whole tables, and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tanyalah.llm import bagminhash, eigen_updates, grid_join, html_trees, imatch, line_dedup, mixing, multi_index, ppm, quality_rules, sentencepiece_trie, toxicity, url_filter

# The tokenizer whose pieces the registered queries use.
VOCABULARY_FILE = "/opt/tokenizers/piece_bpe_32k.model"

URL_RULES = (
    url_filter.Rule("com/", "allow"),
    url_filter.Rule("example.com/en/", "block"),
    url_filter.Rule("www.example.com/en/", "allow"),
    url_filter.Rule("net/es/", "block"),
    url_filter.Rule("net/fr/", "block"),
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rules = quality_rules.fit_rules(docs, table(spark, sf_dir, "labels"))
    return quality_rules.judge(docs, rules).select("row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def pieces(spark: SparkSession, sf_dir: str, vocabulary_file: str = VOCABULARY_FILE) -> DataFrame:
    """Ids of every text as a count and a hash, and whether decoding gives the text back (a mark in it becomes a space)."""
    vocabulary = sentencepiece_trie.read_vocabulary(vocabulary_file)
    rows = sentencepiece_trie.encode_and_decode(table(spark, sf_dir, "documents"), vocabulary)
    same = F.col("decoded") == F.translate(F.coalesce("text", F.lit("")), sentencepiece_trie.MARK, " ")
    return rows.select("row.doc_id", F.size("ids").cast("long").alias("n_pieces"), F.xxhash64("ids").alias("ids_hash"), F.sha2("decoded", 256).alias("decoded_sha256"), same.alias("round_trip"))


def language_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ppm.score_texts(table(spark, sf_dir, "documents"))


def fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imatch.fingerprint_and_edit(table(spark, sf_dir, "documents"))


def mixed_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def main_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = html_trees.fit_pages(html_trees.training_pages(table(spark, sf_dir, "documents")))
    return html_trees.extract(table(spark, sf_dir, "pages"), model)


def line_dedups(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = line_dedup.with_kept_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select("doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_dropped").alias("n_dropped"), F.sha2("_kept", 256).alias("kept_sha256"))


def near_duplicate_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bagminhash.near_duplicates(table(spark, sf_dir, "documents"))


def toxicity_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of rows whose hash is 0 modulo 5 are never learned from."""
    held_out = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(5)) == 0
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit_toxicity(docs, table(spark, sf_dir, "labels").where(~held_out))
    return toxicity.score_toxicity(docs, model).select("doc_id", held_out.alias("held_out"), "score", "predicted", "n_matches")


def url_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(url, block) for the pages whose number has a label: block where it is toxic or of low quality."""
    number = F.expr("try_cast(regexp_extract(url, '://[^/]*/[^/]*/([0-9]+)', 1) as bigint)")
    pages = table(spark, sf_dir, "pages").select("url", number.alias("doc_id")).where("doc_id is not null")
    block = F.when((F.col("toxic") == 1) | (F.col("quality") == 0), F.lit(1)).otherwise(F.lit(0))
    return pages.join(table(spark, sf_dir, "labels"), "doc_id").select("url", block.alias("block"))


def url_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = url_filter.fit_urls(url_labels(spark, sf_dir))
    return url_filter.judge_urls(table(spark, sf_dir, "pages"), URL_RULES, model)


def embedding_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid_join.linked_vectors(table(spark, sf_dir, "embeddings"))


def hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose id is divisible by 7 have the next label, so that some neighbours are negatives."""
    number = F.col("vec_id")
    label = F.when(number % 7 == 0, F.pmod(F.col("label") + 1, F.lit(10))).otherwise(F.col("label"))
    return multi_index.mine_hard_negatives(table(spark, sf_dir, "embeddings"), number % 50 == 0, label=label)


def whitened_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return eigen_updates.whitened(table(spark, sf_dir, "embeddings"))


LLM_QUERIES = {
    "op1_quality_rules": quality,
    "op2_sentencepiece": pieces,
    "op3_ppm_scoring": language_scores,
    "op4_fingerprints": fingerprints,
    "op5_mixing": mixed_sources,
    "op6_html_extraction": main_texts,
    "op7_line_dedup": line_dedups,
    "op8_near_duplicates": near_duplicate_classes,
    "op9_toxicity": toxicity_scores,
    "op10_url_filter": url_verdicts,
    "op11_embedding_near_dup": embedding_classes,
    "op12_hard_negatives": hard_negatives,
    "op13_whitening": whitened_vectors,
}

LINE_DEDUP_SQL = r"""
with lines as (
  select doc_id, pos, line,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key
  from (select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line,
               generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as pos from documents)
), shared as (
  select key, min(doc_id) as keeper from lines where length(key) >= 10 group by key having count(distinct doc_id) > 1
), judged as (
  select l.doc_id, l.pos, l.line, s.key is not null and l.doc_id <> s.keeper as gone
  from lines l left join shared s on l.key = s.key
)
select doc_id, count(*) as n_lines, count(*) filter (where gone) as n_dropped,
       sha256(coalesce(string_agg(line, chr(10) order by pos) filter (where not gone), '')) as kept_sha256
from judged group by doc_id
"""

MIXING_SQL = r"""
with sized as (
  select doc_id, source, coalesce(source, '') as name, source is null as none, text,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) as size,
         cast('0x' || substr(md5(coalesce(cast(doc_id as varchar), '') || '/' || coalesce(text, '')), 1, digits) as bigint) as salt
  from documents, (select cast(greatest(2, ceil(log(16, greatest(count(*), 1) / 262144))) as int) as digits from documents)
), sources as (
  select source, name, none, cast(sum(size) as bigint) as source_size from sized group by all
), weighted as (
  select *, case (row_number() over (order by none, name) - 1) % 3 when 0 then 5 when 1 then 2 else 1 end as weight from sources
), filling as (
  select *, 2 * source_size as cap, 2 * source_size / weight as fill, (select sum(source_size) from sources) * 1.5::double as total from weighted
), leveled as (
  select *, row_number() over o as place, (total - coalesce(sum(cap) over (o rows between unbounded preceding and 1 preceding), 0))
            / sum(weight) over (o rows between current row and unbounded following) as level
  from filling window o as (order by fill, none, name)
), targets as (
  select *, least(coalesce((select arg_min(level, place) from leveled where level <= fill), fill) * weight, cast(cap as double)) as target from leveled
), ranked as (
  select d.doc_id, d.size, t.source_size, t.target, d.name,
         row_number() over (partition by d.name, d.none order by length(bin(d.size)), d.salt, d.size, d.doc_id) as rank
  from sized d join targets t on d.name = t.name and d.none = t.none
), ratios as (
  select *, case when source_size > 0 then target / source_size else 0.0::double end as ratio,
         cast('0x' || substr(md5(name || 'mix'), 1, 8) as bigint) / 4294967296.0::double as start
  from ranked
)
select doc_id, size, source_size, target,
       cast(floor(rank * ratio + start) - floor((rank - 1) * ratio + start) as bigint) * size as taken
from ratios
"""

_FINITE = "embedding is not null and len(list_filter(embedding, lambda c: c is null or not isfinite(c))) = 0"

EMBEDDING_CLASSES_SQL = f"""
with recursive vectors as (
  select vec_id, label, embedding::double[] as v from embeddings
  where label is not null and {_FINITE} and len(list_filter(embedding, lambda c: c <> 0)) > 0
), links as (
  select a.vec_id as a, b.vec_id as b from vectors a join vectors b on a.label = b.label and a.vec_id <> b.vec_id
  where list_cosine_similarity(a.v, b.v) >= 0.98
), reach as (
  select a as node, b as other from links union select r.node, l.b from reach r join links l on r.other = l.a
), least as (
  select node, min(other) as other from reach group by node
), counts as (
  select a, count(*) as n from links group by a
)
select vec_id, coalesce(n, 0) as n_links, least(vec_id, coalesce(other, vec_id)) as component_id,
       vec_id = least(vec_id, coalesce(other, vec_id)) as kept
from embeddings left join counts on a = vec_id left join least on node = vec_id
"""

HARD_NEGATIVES_SQL = f"""
with vectors as (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
         list_transform(embedding, lambda c: floor(256 * c::double)::bigint) as x
  from embeddings where label is not null and {_FINITE}
), scored as (
  select a.vec_id as anchor_id, b.vec_id as other_id, a.label = b.label as same,
         list_inner_product(a.x::double[], b.x::double[])::bigint as score
  from vectors a join vectors b on a.vec_id <> b.vec_id where a.vec_id % 50 = 0
), positives as (
  select anchor_id, other_id as positive_id, score as positive_score from scored where same
  qualify row_number() over (partition by anchor_id order by score desc, other_id) <= 5
)
select anchor_id, positive_id,
       (row_number() over (partition by anchor_id, positive_id order by score desc, other_id))::integer as rank,
       other_id as negative_id, positive_score, score as negative_score
from positives join scored using (anchor_id)
where not same and 50 * positive_score <= 100 * score and 100 * score <= 95 * positive_score
qualify rank <= 3
"""

LLM_ORACLES = {
    "op5_mixing": MIXING_SQL,
    "op7_line_dedup": LINE_DEDUP_SQL,
    "op11_embedding_near_dup": EMBEDDING_CLASSES_SQL,
    "op12_hard_negatives": HARD_NEGATIVES_SQL,
}
