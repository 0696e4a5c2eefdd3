"""Quality rules as a ledger of bits.

Every rule is evaluated once per document; the ledger keeps the measurements
and one long with a bit per failed rule.  Policies are versions of a bit mask,
so a verdict, a change of policy and an ablation read the ledger only and never
the texts.  Column functions alone: one scan, no shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from footfall.llm.common import words_of

MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")


@dataclass(frozen=True)
class Rule:
    """A named rule; ``failed`` is SQL over the measurements."""

    bit: int
    name: str
    failed: str


RULES = (
    Rule(0, "few_words", "n_words < 50"),
    Rule(1, "repeated_words", "100 * n_repeat_words > 50 * n_words"),
    Rule(2, "many_symbols", "10 * n_symbols > n_words"),
    Rule(3, "repeated_lines", "2 * n_dup_lines > n_lines"),
    Rule(4, "word_length", "word_chars < 2 * n_words or word_chars > 12 * n_words"),
)
BASE_MASK = 0b00011
POLICIES = {"base": BASE_MASK, "v1": 0b00111, "v2": 0b11111}
CURRENT = "v2"


def _repeat_words(words: Column) -> dict[str, Column]:
    """Steps to the number of words inside 3-word windows that occur twice or more.

    Windows are sorted with their positions; neighbours that are equal are the
    repeated ones, and the sorted positions give the words they cover.
    """
    starts = F.slice(words, 1, F.greatest(F.size(words) - 2, F.lit(0)))
    windows = F.transform(starts, lambda w, i: F.struct(F.concat_ws(" ", w, F.get(words, i + 1), F.get(words, i + 2)).alias("w"), i.alias("i")))
    ordered = F.col("__ordered")
    same = lambda a, b: F.coalesce(a["w"] == b["w"], F.lit(False))
    hits = F.filter(ordered, lambda s, k: same(s, F.get(ordered, k - 1)) | same(s, F.get(ordered, k + 1)))
    at = F.col("__at")
    covered = F.transform(at, lambda p, k: F.least(F.lit(3), F.coalesce(F.get(at, k + 1) - p, F.lit(3))))
    return {
        "__ordered": F.sort_array(windows),
        "__at": F.sort_array(F.transform(hits, lambda s: s["i"])),
        "n_repeat_words": F.aggregate(covered, F.lit(0).cast("long"), lambda total, n: total + n),
    }


def _ledger_over(docs: DataFrame, text: str) -> DataFrame:
    """Columns __row (the input row), the measurements and failed_bits."""
    df = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("__text"))
    df = df.select("__row", "__text", words_of(F.col("__text")).alias("__words"))
    df = df.withColumn("__lines", F.filter(F.split("__text", "\n", -1), lambda x: x.rlike(r"[^ \t-\r]")))
    for name, column in _repeat_words(F.col("__words")).items():
        df = df.withColumn(name, column)
    df = df.select(
        "__row",
        F.size("__words").cast("long").alias("n_words"),
        F.length(F.array_join("__words", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("__text", r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        F.size("__lines").cast("long").alias("n_lines"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
        "n_repeat_words",
    )
    bits = F.lit(0).cast("long")
    for rule in RULES:
        bits = bits.bitwiseOR(F.when(F.expr(rule.failed), F.lit(1 << rule.bit)).otherwise(F.lit(0)).cast("long"))
    return df.withColumn("failed_bits", bits)


def ledger(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: key, measurements, failed_bits.

    A null or blank text has no words and fails few_words; a null key stays;
    repeated rows are judged one by one; an empty table gives an empty ledger;
    other columns of the input are ignored, whatever their names.
    """
    return _ledger_over(docs.select(key, text), text).select(F.col(f"__row.{key}").alias(key), *MEASURES, "failed_bits")


def fails(mask: int, bits: str = "failed_bits") -> Column:
    """True where a rule of the mask failed."""
    return F.col(bits).bitwiseAND(F.lit(mask).cast("long")) != 0


def apply_policy(book: DataFrame, version: str = CURRENT) -> DataFrame:
    """The ledger with the verdict of a policy version in ``kept``."""
    return book.withColumn("kept", ~fails(POLICIES[version]))


def filter_documents(docs: DataFrame, text: str = "text", version: str = CURRENT) -> DataFrame:
    """Documents that pass a policy, with their own columns only.

    The row number keeps the filter above the measurements: pushed below them it
    would repeat their steps inside each other.
    """
    book = _ledger_over(docs, text).withColumn("__number", F.monotonically_increasing_id())
    return book.where((F.col("__number") >= 0) & ~fails(POLICIES[version])).select("__row.*")


def ablations(book: DataFrame, version: str = CURRENT) -> DataFrame:
    """Per rule of a policy: what it rejects, alone and with others, and what stays without it.

    Documents are first counted by bit pattern, at most 2 to the number of rules
    rows; all figures come from the patterns by bitwise comparison.
    """
    mask = POLICIES[version]
    rules = F.array(*[F.struct(F.lit(r.name).alias("rule"), F.lit(1 << r.bit).cast("long").alias("bit")) for r in RULES if mask >> r.bit & 1])
    hit = F.col("failed_bits").bitwiseAND(F.lit(mask).cast("long"))
    patterns = book.groupBy(hit.alias("bits")).agg(F.count(F.lit(1)).alias("docs"))
    each = patterns.withColumn("r", F.explode(rules)).select("bits", "docs", "r.rule", "r.bit")
    among = lambda test: F.coalesce(F.sum(F.when(test, F.col("docs"))), F.lit(0)).alias
    return each.groupBy("rule", "bit").agg(
        among(F.col("bits").bitwiseAND(F.col("bit")) != 0)("rejected"),
        among(F.col("bits") == F.col("bit"))("rejected_alone"),
        among(F.col("bits").bitwiseAND(F.bitwise_not("bit")) == 0)("kept_without"),
    )
