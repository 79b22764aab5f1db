"""Quality rules as a ledger: every rule is measured once, failures are bits, policies are masks.

Only SQL functions. The ledger keeps the measurements and one ``failures`` number per document; a policy names the
rules that reject, so trying another policy, or leaving one rule out, reads the ledger and never the texts.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words are runs of anything but these.
BLANKS = "\\x20\\x09-\\x0D"
SYMBOLS = "#*$%&|<>"

#: Rule by rule, in bit order: name and the condition under which a document fails it.
RULES: dict[str, str] = {
    "few_words": "n_words < 20",
    "repeated_words": "100 * n_repeat_words > 30 * n_words",
    "symbols": "100 * n_symbols > 8 * word_chars",
    "exclamations": "100 * n_exclamations > 5 * word_chars",
    "repeated_lines": "100 * n_dup_lines > 50 * n_lines",
    "short_words": "word_chars < 2 * n_words",
    "long_words": "word_chars > 25 * n_words",
}

#: Policies by version; later ones are added, none is changed.
POLICIES: dict[str, tuple[str, ...]] = {
    "base": ("few_words", "repeated_words"),
    "v1": ("few_words", "repeated_words", "symbols", "exclamations", "repeated_lines"),
    "v2": tuple(RULES),
}

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_exclamations")


def mask(policy: str) -> int:
    """The bits of a policy's rules."""
    names = list(RULES)
    return sum(1 << names.index(r) for r in POLICIES[policy])


def measured(docs: DataFrame, carried: list[str], window: int = 8) -> DataFrame:
    """``row`` (a struct of the columns ``carried``) and ``m`` (a struct of the measurements) of every row of ``docs``.

    ``n_repeat_words`` counts words inside windows of ``window`` words that occur twice or more in the text, the
    first occurrence included. Windows are compared by a 64-bit hash: two of a text's n windows are taken for
    equal wrongly with a chance below n * n / 2**65. Where all differ, nothing further is done; else they are
    sorted with their positions, and equal neighbours mark the positions to cover. Time is n log n, memory that
    of the text, and no row meets another. Null text counts as empty: all measurements are 0.
    """
    t = "coalesce(cast(text AS string), '')"
    out = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in carried]).alias("row"),
        F.expr(f"filter(split({t}, '[{BLANKS}]+'), w -> w <> '')".replace("\\", "\\\\")).alias("words"),
        F.expr(f"filter(split({t}, '\n'), l -> l rlike '[^{BLANKS}]')".replace("\\", "\\\\")).alias("lines"),
        F.expr(f"char_length(translate({t}, ' \t\n\x0b\x0c\r', ''))").alias("chars"),
        F.expr(f"char_length({t}) - char_length(translate({t}, '{SYMBOLS}', ''))").alias("symbols"),
        F.expr(f"char_length({t}) - char_length(translate({t}, '!', ''))").alias("bangs"),
    )
    out = out.select(
        "row", "chars", "symbols", "bangs", F.size("words").alias("n"), F.size("lines").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).alias("again"),
        F.expr(f"CASE WHEN size(words) > {window} THEN transform(sequence(1, size(words) - {window - 1}), i -> xxhash64(slice(words, i, {window}))) END").alias("hashes"))
    out = out.withColumn("sorted", F.expr(
        "CASE WHEN size(array_distinct(hashes)) < size(hashes) THEN array_sort(transform(hashes, (h, i) -> struct(h AS h, i AS i))) END")).drop("hashes")
    covered = f"""
        aggregate(
            array_sort(transform(
                filter(sorted, (x, k) -> coalesce(x.h = get(sorted, k - 1).h, false) OR coalesce(x.h = get(sorted, k + 1).h, false)), x -> x.i)),
            struct(0L AS n, 0 AS upto),
            (a, i) -> struct(a.n + (i + {window} - greatest(a.upto, i)) AS n, i + {window} AS upto),
            a -> a.n)"""
    named = {"n_words": "n", "word_chars": "chars", "n_symbols": "symbols", "n_dup_lines": "again", "n_lines": "n_lines", "n_exclamations": "bangs"}
    fields = [F.col(v).cast("long").alias(k) for k, v in named.items()]
    return out.select("row", F.struct(*fields, F.coalesce(F.expr(covered), F.lit(0)).cast("long").alias("n_repeat_words")).alias("m"))


def failures(m: str = "") -> Column:
    """The bits of the rules that measurements fail; ``m`` names the struct that holds them, if one does."""
    out = F.lit(0).cast("long")
    for i, rule in enumerate(RULES.values()):
        named = re.sub(r"\b[a-z_]+\b", lambda x: f"{m}.{x[0]}", rule) if m else rule
        out = out.bitwiseOR(F.when(F.expr(named), F.lit(1 << i).cast("long")).otherwise(F.lit(0).cast("long")))
    return out


def ledger(docs: DataFrame) -> DataFrame:
    """One row per document: ``doc_id``, the measurements, and ``failures`` (a bit per rule of ``RULES``).

    Repeated rows and null ids are kept; other columns are dropped, whatever their names.
    """
    m = measured(docs, ["doc_id"]).select("row.doc_id", *[F.col(f"m.{c}").alias(c) for c in MEASURES])
    return m.withColumn("failures", failures())


def verdicts(ledger_rows: DataFrame, policy: str) -> DataFrame:
    """The ledger with ``base_failed`` and ``kept`` under a policy."""
    hit = lambda p: F.col("failures").bitwiseAND(F.lit(mask(p)).cast("long")) != 0
    return ledger_rows.withColumn("base_failed", hit("base")).withColumn("kept", ~hit("base") & ~hit(policy))


def keep(docs: DataFrame, policy: str) -> DataFrame:
    """The rows of ``docs`` that no rule of the policy or of ``base`` rejects; all columns as they are.

    The bits leave through a generator, as a filter on a plain column would be pushed below the measurements and
    make each of them anew for every rule.
    """
    rejecting = F.lit(mask(policy) | mask("base")).cast("long")
    told = measured(docs, docs.columns).select("row", F.explode(F.array(failures("m"))).alias("bits"))
    return told.where(F.col("bits").bitwiseAND(rejecting) == 0).select("row.*")


def ablations(ledger_rows: DataFrame, policies: tuple[str, ...] = tuple(POLICIES)) -> DataFrame:
    """Per policy and rule: documents that it fails, that only it fails, and that the policy rejects.

    The ledger is first counted by ``failures``, which leaves at most 2 ** rules rows.
    """
    counted = ledger_rows.groupBy("failures").agg(F.count("*").alias("n"))
    names = list(RULES)
    cases = F.explode(F.array(*[
        F.struct(F.lit(p).alias("policy"), F.lit(r).alias("rule"), F.lit(mask(p)).cast("long").alias("mask"), F.lit(1 << names.index(r)).cast("long").alias("bit"))
        for p in policies for r in POLICIES[p]])).alias("c")
    hit = F.col("failures").bitwiseAND(F.col("c.mask"))
    total = lambda when: F.sum(F.when(when, F.col("n")).otherwise(0))
    return counted.select("failures", "n", cases).groupBy("c.policy", "c.rule").agg(
        total(hit.bitwiseAND(F.col("c.bit")) != 0).alias("failed"), total(hit == F.col("c.bit")).alias("failed_alone"), total(hit != 0).alias("rejected"))
