"""Quality rules as a bitmask ledger, in DataFrame functions only.

Every rule is evaluated once per document; the ledger stores the measurements and one bit per failed
rule. Policies are versioned sets of bits: applying one is a bitwise AND, and what a rule contributes
(its ablation) is a bitwise aggregation over the ledger, with no text read again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.shared import NO_WORD, words_of

WINDOW = 8

#: The rules, by bit; (name, what fails it).
RULES: list[tuple[str, str]] = [
    ("few_words", "n_words < 20"),
    ("repeated_windows", "100 * n_repeat_words > 30 * n_words"),
    ("symbols", "100 * n_symbols > 8 * word_chars"),
    ("long_words", "word_chars > 20 * n_words"),
    ("repeated_lines", "n_lines >= 4 and 100 * n_dup_lines > 50 * n_lines"),
    ("shouting", "n_letters >= 40 and 100 * n_upper > 70 * n_letters"),
]
#: Policies by version; the rules each one applies.
POLICIES: dict[str, list[str]] = {
    "base-1": ["few_words", "repeated_windows"],
    "web-1": ["few_words", "repeated_windows", "symbols", "long_words", "repeated_lines", "shouting"],
}
BIT = {name: 1 << k for k, (name, _) in enumerate(RULES)}
MEASURES = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_letters", "n_upper"]


def mask(policy: str) -> int:
    return sum(BIT[name] for name in POLICIES[policy])


def _covered(ordered: str, n: int) -> Column:
    """Words in n-word windows found twice or more; `ordered` holds (hash, place) of each window, sorted.

    Windows equal to a neighbour are kept; over their sorted places the covered words are the sum of
    min(n, gap to the place before).
    """
    same = F.filter(ordered, lambda x, k: (F.get(ordered, k - 1)["h"] == x["h"]) | (F.get(ordered, k + 1)["h"] == x["h"]))
    places = F.array_sort(F.transform(same, lambda x: x["i"]))
    return F.aggregate(
        places,
        F.struct(F.lit(0).alias("n"), F.lit(-n).alias("last")),
        lambda s, i: F.struct((s["n"] + F.least(F.lit(n), i - s["last"])).alias("n"), i.alias("last")),
        lambda s: s["n"],
    )


def measure(docs: DataFrame, text: str = "text", window: int = WINDOW) -> DataFrame:
    """The input's columns and the measurements of each row.

    A null or empty text has no words and zeros everywhere. Columns of the input named like a
    measurement are replaced. Rows are judged one by one: repeats and ties change nothing.
    """
    docs = docs.drop(*MEASURES)
    step = docs.select(F.struct(*docs.columns).alias("_row"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    t = F.col("_text")
    step = step.withColumn("_words", words_of(t)).withColumn("_lines", F.filter(F.split(t, "\n"), lambda x: x.rlike(NO_WORD)))
    step = step.withColumn("_n", F.size("_words"))
    hashed = F.transform("_words", lambda w: F.xxhash64(w))
    step = step.withColumn("_hash", F.when(F.col("_n") > window, hashed))
    windows = F.transform(F.sequence(F.lit(1), F.col("_n") - window + 1), lambda i: F.xxhash64(F.slice("_hash", i, window)))
    step = step.withColumn("_windows", F.when(F.col("_hash").isNotNull(), windows))
    numbered = F.array_sort(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    step = step.withColumn("_ordered", F.when(F.size(F.array_distinct("_windows")) < F.size("_windows"), numbered))
    repeats = F.when(F.col("_ordered").isNotNull(), _covered("_ordered", window)).otherwise(F.lit(0))
    letters = F.regexp_replace(F.concat_ws("", "_words"), r"[^\p{L}]+", "")
    step = step.withColumn("_letters", letters)
    measured = step.select(
        "_row",
        F.col("_n").cast("long").alias("n_words"),
        F.char_length(F.concat_ws("", "_words")).cast("long").alias("word_chars"),
        F.regexp_count(t, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        repeats.cast("long").alias("n_repeat_words"),
        F.char_length("_letters").cast("long").alias("n_letters"),
        F.regexp_count("_letters", F.lit(r"\p{Lu}")).cast("long").alias("n_upper"),
    )
    return measured.select(*[F.col("_row")[c].alias(c) for c in docs.columns], *MEASURES)


def ledger(docs: DataFrame, text: str = "text") -> DataFrame:
    """`measure` and `failed_bits`: bit k is set if rule k fails."""
    bits = None
    for name, fails in RULES:
        bit = F.when(F.expr(fails), F.lit(BIT[name])).otherwise(F.lit(0))
        bits = bit if bits is None else bits.bitwiseOR(bit)
    return measure(docs.drop("failed_bits"), text).withColumn("failed_bits", bits.cast("long"))


def apply_policy(rows: DataFrame, policy: str, out: str = "kept") -> DataFrame:
    """Add whether a ledger row passes a policy version."""
    return rows.withColumn(out, F.col("failed_bits").bitwiseAND(F.lit(mask(policy))) == 0)


def passing(rows: DataFrame, policy: str) -> DataFrame:
    """Ledger rows that pass a policy version.

    A plain filter on the ledger would be moved below the measurements and evaluate each of them again. What a
    generator makes can't be tested before it, so the filter stays behind and every rule is evaluated once.
    """
    bits = F.col("failed_bits").bitwiseAND(F.lit(mask(policy)))
    passes = max(rows.columns, key=len) + "_passes"  # no column of the input has this name
    return rows.withColumn(passes, F.explode_outer(F.array(bits == 0))).filter(F.col(passes)).drop(passes)


def ablation(rows: DataFrame, policy: str) -> DataFrame:
    """For each rule of a policy: rows that fail it, and rows that fail nothing else (kept if the rule were dropped)."""
    m = mask(policy)
    masked = F.col("failed_bits").bitwiseAND(F.lit(m))
    sums = rows.agg(
        *[F.sum(F.when(masked.bitwiseAND(F.lit(BIT[r])) != 0, 1).otherwise(0)).alias(f"f_{r}") for r in POLICIES[policy]],
        *[F.sum(F.when(masked == BIT[r], 1).otherwise(0)).alias(f"o_{r}") for r in POLICIES[policy]],
    )
    each = F.array(*[F.struct(F.lit(r).alias("rule"), F.coalesce(f"f_{r}", F.lit(0)).alias("failed"), F.coalesce(f"o_{r}", F.lit(0)).alias("only_failure")) for r in POLICIES[policy]])
    return sums.select(F.inline(each))


def ablations(rows: DataFrame, policies: list[str] | None = None) -> DataFrame:
    """`ablation` of several policy versions over one ledger: (policy, rule, failed, only_failure)."""
    out = None
    for policy in policies or list(POLICIES):
        part = ablation(rows, policy).select(F.lit(policy).alias("policy"), "rule", F.col("failed").cast("long").alias("failed"), F.col("only_failure").cast("long").alias("only_failure"))
        out = part if out is None else out.unionByName(part)
    return out
