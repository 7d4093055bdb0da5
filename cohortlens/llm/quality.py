"""Quality rules as a bitmask ledger: every rule is measured once, failures are kept as bits, and versioned
policies and ablations are bitwise work on the ledger.  Native DataFrame code only."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WHITESPACE, take

SYMBOLS = "#*$%&|<>"


def _c(name: str) -> Column:
    return F.col(name)


#: Rules in bit order; each is true where a document fails.  Ratios are compared in whole numbers.
RULES: tuple[tuple[str, Column | object], ...] = (
    ("few_words", lambda: _c("n_words") < 50),
    ("repeat_words", lambda: F.lit(100) * _c("n_repeat_words") > F.lit(50) * _c("n_words")),
    ("many_words", lambda: _c("n_words") > 100_000),
    ("short_words", lambda: _c("word_chars") < F.lit(3) * _c("n_words")),
    ("long_words", lambda: _c("word_chars") > F.lit(12) * _c("n_words")),
    ("symbols", lambda: F.lit(10) * _c("n_symbols") > _c("n_words")),
    ("dup_lines", lambda: F.lit(10) * _c("n_dup_lines") > F.lit(3) * _c("n_lines")),
)
BITS = {name: 1 << i for i, (name, _) in enumerate(RULES)}


@dataclass(frozen=True)
class Policy:
    """A document is rejected if it fails any of ``rules``."""

    version: str
    rules: Sequence[str]

    @property
    def mask(self) -> int:
        return sum(BITS[r] for r in self.rules)


POLICIES: Mapping[str, Policy] = {
    p.version: p
    for p in (
        Policy("base", ("few_words", "repeat_words")),
        Policy("v1", ("few_words", "repeat_words", "many_words", "short_words", "long_words", "symbols", "dup_lines")),
        Policy("v2", ("few_words", "repeat_words", "many_words", "short_words", "long_words", "symbols")),
    )
}


def measurements(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Whole-text measurements, one row per input row, without a shuffle.

    ``n_words`` (maximal runs of characters other than space, tab, LF, VT, FF and CR), ``word_chars`` (code points
    in words), ``n_symbols``, ``n_lines`` (LF-split lines with a word), ``n_dup_lines`` (of those, equal to an
    earlier one) and ``n_repeat_words`` (words inside 3-word windows found twice or more in the text).  Windows
    are compared by a 64-bit hash of their words within one text.

    A null text measures as an empty one (all zero).  Repeated rows give repeated rows; other columns are not read.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    spaced = F.translate(text, "\t\n\x0b\x0c\r", " " * 5)
    base = take(docs, id=id_col, text=text_col).select(
        "id",
        F.filter(F.split(spaced, " "), lambda w: w != "").alias("words"),
        F.filter(F.split(text, "\n"), lambda s: F.translate(s, WHITESPACE, "") != "").alias("lines"),
        F.length(F.translate(text, WHITESPACE, "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
    )
    starts = F.sequence(F.lit(1), F.size("words") - 2)
    windows = base.select(
        "id", "word_chars", "n_symbols",
        F.size("words").cast("long").alias("n_words"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.size("words") >= 3,
               F.transform(F.arrays_zip(F.col("words").alias("a"), F.slice("words", 2, F.size("words")).alias("b"),
                                        F.slice("words", 3, F.size("words")).alias("c")),
                           lambda z: F.xxhash64(z["a"], z["b"], z["c"])))
        .otherwise(F.array().cast("array<bigint>")).alias("hashed"),
        F.when(F.size("words") >= 3, starts).otherwise(F.array().cast("array<int>")).alias("at"),
    )
    # the two padded entries past the last window are cut off; then (hash, start) in order brings equal windows together
    windows = windows.withColumn("hashed", F.slice("hashed", 1, F.size("at")))
    repeats = F.size(F.array_distinct("hashed")) < F.size("hashed")
    sorted_windows = F.when(repeats, F.array_sort(F.arrays_zip("hashed", "at")))
    ordered = windows.select("id", "word_chars", "n_symbols", "n_words", "n_lines", "n_dup_lines",
                             sorted_windows.alias("w"))
    found = F.filter(
        F.zip_with(
            F.zip_with(F.col("w"), F.slice("w", 2, F.size("w")),
                       lambda x, y: F.struct(x["hashed"].alias("h"), x["at"].alias("at"),
                                             (x["hashed"] == y["hashed"]).alias("next"))),
            F.concat(F.array(F.lit(None).cast("struct<hashed:bigint,at:int>")), F.col("w")),
            lambda x, y: F.when(x["next"] | (x["h"] == y["hashed"]), x["at"])),
        lambda p: p.isNotNull())
    hit = ordered.withColumn("hit", F.when(F.col("w").isNotNull(), F.array_sort(found)))
    # each hit start covers three words; the next start cuts what it covers itself
    covered = F.aggregate(
        F.zip_with(F.col("hit"), F.slice("hit", 2, F.size("hit")),
                   lambda a, b: F.least(F.coalesce(b - a, F.lit(3)), F.lit(3))),
        F.lit(0), lambda acc, x: acc + x)
    return hit.select(F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines",
                      F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"))


def ledger(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Measurements plus ``failed_bits``: bit i is set where rule i of ``RULES`` fails."""
    bits = F.lit(0)
    for name, failed in RULES:
        bits = bits.bitwiseOR(F.when(failed(), F.lit(BITS[name])).otherwise(F.lit(0)))
    return measurements(docs, id_col=id_col, text_col=text_col).withColumn("failed_bits", bits)


def apply_policy(marked: DataFrame, policy: Policy) -> DataFrame:
    """``kept`` under a policy: no bit of its mask is set.  Works on a ledger, never on texts."""
    return marked.withColumn("kept", F.col("failed_bits").bitwiseAND(F.lit(policy.mask)) == 0)


def ablations(marked: DataFrame, policy: Policy) -> DataFrame:
    """Per rule of the policy: documents it fails, and those it alone rejects (kept again without the rule).

    One aggregation over the ledger; an empty ledger gives zero counts."""
    mask = policy.mask
    mine = F.col("failed_bits").bitwiseAND(F.lit(mask))
    counted = marked.agg(
        F.count("*").alias("n_docs"), F.count_if(mine != 0).alias("n_rejected"),
        *[F.count_if(mine.bitwiseAND(F.lit(BITS[r])) != 0).alias(f"{r}__failed") for r in policy.rules],
        *[F.count_if(mine == BITS[r]).alias(f"{r}__alone") for r in policy.rules])
    return counted.select(F.explode(F.array(*[
        F.struct(F.lit(policy.version).alias("policy"), F.lit(r).alias("rule"), F.col("n_docs"), F.col("n_rejected"),
                 F.col(f"{r}__failed").alias("n_failed"), F.col(f"{r}__alone").alias("n_only_this"))
        for r in policy.rules])).alias("x")).select("x.*")
