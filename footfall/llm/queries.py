"""Registered queries of the subpackage and their check SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from footfall.llm import (
    exact_copies, line_dedup, middle_frames, mixing, packing, passages, quality_rules, simhash_trees, suffix_repeats, url_templates,
    vector_blocks, warc_segments, whitening,
)
from footfall.llm.common import read_table
from footfall.session import scratch_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_vector_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all embeddings at cosine 0.98."""
    return vector_blocks.near_vectors(read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))


@query
def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of the token pieces of all documents in sequences of 1024."""
    pieces = packing.token_pieces(read_table(spark, sf_dir, "documents").select("doc_id", "text")).drop("ids")
    return packing.packed_pieces(pieces).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", F.col("offset").cast("long").alias("offset"))


@query
def op3_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints and near-copy components of all documents."""
    found = simhash_trees.near_duplicates(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


@query
def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts of all page urls; the pages that a rule judges label the templates."""
    return url_templates.judge(read_table(spark, sf_dir, "pages").select("page_id", "url"))


@query
def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of all documents that an earlier line resembles, and a digest of what is left."""
    docs = line_dedup.without_repeated_lines(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return docs.select(
        "doc_id", F.col("__n_lines").cast("long").alias("n_lines"), F.size("__removed").cast("long").alias("n_removed"),
        F.col("__removed").alias("removed"), F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256).alias("kept_sha256"),
    )


@query
def op6_warc_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages archived below the shared folder and read back."""
    path = scratch_path(spark, "warc")
    warc_segments.write_archives(read_table(spark, sf_dir, "pages").select("page_id", "url", "html"), path)
    return warc_segments.page_digests(warc_segments.reassemble(warc_segments.read_records(spark, path)))


@query
def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality ledger of all documents with the verdict of the current policy."""
    book = quality_rules.apply_policy(quality_rules.ledger(read_table(spark, sf_dir, "documents")))
    return book.withColumn("base_failed", quality_rules.fails(quality_rules.BASE_MASK))


ORACLE["op7_quality_rules"] = """
with t as (select row_number() over () as rid, doc_id, coalesce(text, '') as text from documents),
w as (select rid, [x for x in string_split_regex(text, '[ \\t-\\r]+') if x <> ''] as w,
        [x for x in string_split(text, chr(10)) if regexp_matches(x, '[^ \\t-\\r]')] as l from t),
g as (select rid, unnest(range(1, len(w) - 1)) as i, w from w),
s as (select rid, i, count(*) over (partition by rid, w[i], w[i + 1], w[i + 2]) as n from g),
p as (select distinct rid, i + unnest([0, 1, 2]) as i from s where n > 1),
r as (select rid, count(*) as n_repeat_words from p group by rid),
m as (
  select doc_id, cast(len(w) as bigint) as n_words,
    cast(length(list_aggregate(w, 'string_agg', '')) as bigint) as word_chars0,
    cast(length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) as bigint) as n_symbols,
    cast(len(l) as bigint) as n_lines, cast(len(l) - len(list_distinct(l)) as bigint) as n_dup_lines,
    coalesce(n_repeat_words, 0) as n_repeat_words
  from t join w using (rid) left join r using (rid)),
b as (
  select doc_id, n_words, coalesce(word_chars0, 0) as word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words,
    cast(n_words < 50 as bigint) + 2 * cast(100 * n_repeat_words > 50 * n_words as bigint)
    + 4 * cast(10 * n_symbols > n_words as bigint) + 8 * cast(2 * n_dup_lines > n_lines as bigint)
    + 16 * cast(coalesce(word_chars0, 0) < 2 * n_words or coalesce(word_chars0, 0) > 12 * n_words as bigint) as failed_bits
  from m)
select *, failed_bits = 0 as kept, failed_bits & 3 <> 0 as base_failed from b
"""


@query
def op8_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document."""
    plan = mixing.plan_mix(read_table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return plan.select(
        F.col("__row.doc_id").alias("doc_id"), F.col("__row.source").alias("source"), F.col("__size").alias("size"),
        F.col("__source_size").alias("source_size"), F.col("__target").alias("target"),
        (F.col("__size") * F.col("__copies")).alias("taken"),
    )


@query
def op9_suffix_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of all documents that lie in 400-byte strings which occur again."""
    docs = suffix_repeats.without_repeats(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    removed = F.aggregate("__runs", F.lit(0).cast("long"), lambda total, r: total + r["high"] - r["low"])
    return docs.select(
        "doc_id", F.col("__bytes").alias("n_bytes"), removed.alias("n_removed"), F.size("__runs").cast("long").alias("n_spans"),
        F.sha2("__kept", 256).alias("kept_sha256"), F.length("__kept").cast("long").alias("n_kept"),
    )


ORACLE["op8_mix_sources"] = """
with d as (select doc_id, source,
        cast(len([x for x in string_split_regex(coalesce(text, ''), '[ \\t-\\r]+') if x <> '']) as bigint) as size from documents),
s as (select source, cast(sum(size) as bigint) as source_size,
        [3, 1, 2][(row_number() over (order by source nulls last) - 1) % 3 + 1] as weight from d group by source),
c as (select *, source_size * 2 as cap, sum(source_size) over () * 150 / 100.0 as budget from s),
l as (select *, (budget - coalesce(sum(cap) over o, 0)) / (sum(weight) over () - coalesce(sum(weight) over o, 0)) as level
      from c window o as (order by cast(cap as double) / weight, source nulls first rows between unbounded preceding and 1 preceding)),
f as (select l.*, (select first(level order by cast(cap as double) / weight, source nulls first) from l where level * weight <= cap) as lvl from l),
t as (select source, source_size, cast(coalesce(least(lvl * weight, cap), cap) as double) as target from f),
r as (select *, case when source_size > 0 then target / source_size else 1.0 end as rate from t)
select doc_id, d.source, size, source_size, target,
  size * cast(floor(rate) + case when cast('0x' || substr(md5('mix-1:' || coalesce(cast(doc_id as varchar), 'null')), 1, 13) as bigint)
    / cast(4503599627370496 as double) < rate - floor(rate) then 1 else 0 end as bigint) as taken
from d join r on d.source is not distinct from r.source
"""


@query
def op10_passage_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more of all documents that occur again, with their classes."""
    return passages.near_duplicate_passages(read_table(spark, sf_dir, "documents").select("doc_id", "text"))


@query
def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forms, cuts and digests of all documents with the middle moved to the end."""
    made = middle_frames.fill_in_middle(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    made = made.withColumn("__digests", middle_frames.digests("__output", "__form"))
    return made.select(
        "doc_id", F.col("__n").alias("n"), F.col("__form").alias("form"), F.col("__prefix_chars").alias("prefix_chars"),
        F.col("__middle_chars").alias("middle_chars"), "__digests.output_sha256", "__digests.restored_sha256",
    )


ORACLE["op11_fill_in_middle"] = """
with t as (select row_number() over () as rid, doc_id, coalesce(text, '') as text,
        sha256(concat('1:', coalesce(cast(doc_id as varchar), 'null'))) as h from documents),
u as (select *, regexp_extract_all(text, '[A-Za-z]+|[^A-Za-z]') as units from t),
h as (select *, cast(len(units) as bigint) as n, cast('0x' || h[1:8] as bigint) as h1, cast('0x' || h[9:16] as bigint) as h2,
        cast('0x' || h[17:24] as bigint) as h3, cast('0x' || h[25:32] as bigint) as h4 from u),
f as (select *, least(h1 % (n + 1), h2 % (n + 1)) as a, greatest(h1 % (n + 1), h2 % (n + 1)) as b,
        case when text = '' or contains(text, '<P>') or contains(text, '<S>') or contains(text, '<M>') or h3 % 100 >= 90 then 'plain'
             when h4 % 100 < 20 then 'spm' else 'psm' end as form from h),
p as (select doc_id, n, form, text, coalesce(array_to_string(units[1:a], ''), '') as pre, coalesce(array_to_string(units[a + 1:b], ''), '') as mid,
        coalesce(array_to_string(units[b + 1:], ''), '') as suf from f)
select doc_id, n, form, case when form <> 'plain' then cast(length(pre) as bigint) end as prefix_chars,
  case when form <> 'plain' then cast(length(mid) as bigint) end as middle_chars,
  sha256(case form when 'plain' then text when 'psm' then '<P>' || pre || '<S>' || suf || '<M>' || mid
         else '<S>' || suf || '<P>' || pre || '<M>' || mid end) as output_sha256, sha256(text) as restored_sha256
from p
"""


@query
def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings on the 16 leading components of their distinct vectors' covariance."""
    found = whitening.whiten(read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    # The exact deviation is a decimal; the contract's long is null where it doesn't fit.
    return found.withColumn("deviation", F.expr("try_cast(deviation as bigint)"))


@query
def op13_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of equal texts of all documents, with the row of each that stays."""
    found = exact_copies.exact_groups(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(
        "doc_id", F.col("__keep").alias("keep_id"), F.col("__group_size").alias("group_size"), F.col("__kept").alias("kept"),
        F.col("__sha256").alias("text_sha256"),
    )


ORACLE["op13_exact_dedup"] = """
with t as (select doc_id, regexp_replace(coalesce(text, ''), '[ \\t-\\r]+', ' ', 'g') as text from documents)
select doc_id, min(doc_id) over g as keep_id, count(*) over g as group_size,
  row_number() over (partition by text order by doc_id nulls last) = 1 as kept, sha256(text) as text_sha256
from t window g as (partition by text)
"""
