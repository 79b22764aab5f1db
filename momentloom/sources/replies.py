"""Stored model replies: find the JSON, check it, keep the first valid attempt."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from momentloom.functions.expr import held, strip

# JSON type name -> how the variant type reads.
TYPES = {
    "string": r"^STRING$",
    "number": r"^(BIGINT|DOUBLE|FLOAT|DECIMAL.*)$",
    "array": r"^ARRAY<.*$",
    "object": r"^OBJECT<.*$",
}


def json_text(raw: Column) -> Column:
    """The JSON part of a reply: fences removed, then the outermost bracketed stretch if prose surrounds it."""
    s = strip(raw)
    bare = strip(F.regexp_replace(F.regexp_replace(s, r"^```[a-zA-Z]*\n?", ""), r"\n?```\s*$", ""))
    s = F.when(s.startswith("```"), bare).otherwise(s)
    curly, square = F.instr(s, "{"), F.instr(s, "[")
    start = F.when(curly == 0, square).when(square == 0, curly).otherwise(F.least(curly, square))
    closer = F.when(F.substr(s, start, F.lit(1)) == "{", "}").otherwise("]")
    back = F.locate("}", F.reverse(s)), F.locate("]", F.reverse(s))
    tail = F.when(closer == "}", back[0]).otherwise(back[1])
    end = F.when(tail > 0, F.length(s) - tail + 1)
    cut = F.when((start > 0) & (end > start), F.substr(s, start, end - start + 1)).otherwise(s)
    return F.when(F.substring(s, 1, 1).isin("{", "["), s).otherwise(cut)


def type_at(v: Column, path: str) -> Column:
    """Variant type name at ``path``; null when absent."""
    return F.schema_of_variant(F.try_variant_get(v, path, "variant"))


def has_type(v: Column, path: str, kind: str) -> Column:
    return F.coalesce(type_at(v, path).rlike(TYPES[kind]), F.lit(False))


def is_valid(v: Column, required: list[str], types: dict[str, str]) -> Column:
    tests = [v.isNotNull(), F.coalesce(F.schema_of_variant(v).rlike(TYPES["object"]), F.lit(False))]
    tests += [F.coalesce(type_at(v, f"$.{k}"), F.lit("-")) != "-" for k in required]
    tests += [type_at(v, f"$.{k}").isNull() | has_type(v, f"$.{k}", t) for k, t in types.items()]
    return reduce(lambda a, b: a & b, tests)


def parse_model_replies(
    replies: DataFrame, required: list[str], types: dict[str, str], keys: list[str], attempts: int = 2,
) -> DataFrame:
    """First valid reply per key as JSON text ``reply`` with its ``attempt``; null reply when none is valid.

    The valid text travels as a string, so the choice is a partial aggregate, not a sort.
    """
    found = held(held(replies, _text=json_text(F.col("raw"))), _v=F.try_parse_json("_text"))
    v = F.col("_v")
    ok = (F.col("attempt") <= attempts) & is_valid(v, required, types)
    return found.groupBy(*keys).agg(
        F.min_by("_text", F.when(ok, F.col("attempt"))).alias("reply"),
        F.min(F.when(ok, F.col("attempt"))).alias("attempt"),
        F.count("*").alias("n_attempts"),
    )


def claims_at(v: Column, path: str) -> Column:
    """Claims below ``path`` as an array, or null when the list or any entry of it is malformed."""
    entries = F.try_variant_get(v, path, "array<variant>")
    num, text = TYPES["number"], TYPES["string"]

    def fine(e):
        kind_ok = has_type(e, "$.kind", "string")
        t_ok = has_type(e, "$.t", "number")
        vt = F.coalesce(type_at(e, "$.value"), F.lit("VOID"))
        return kind_ok & t_ok & (vt.rlike(num) | vt.rlike(text) | (vt == "VOID"))

    def build(e):
        vt = F.coalesce(type_at(e, "$.value"), F.lit("VOID"))
        return F.struct(
            F.try_variant_get(e, "$.kind", "string").alias("kind"),
            F.try_variant_get(e, "$.t", "double").alias("t"),
            F.when(vt.rlike(num), F.try_variant_get(e, "$.value", "double")).alias("value_num"),
            F.when(vt.rlike(text), F.try_variant_get(e, "$.value", "string")).alias("value_str"),
        )

    return F.when(has_type(v, path, "array") & F.forall(entries, fine), F.transform(entries, build))


def read_claims(texts: Column) -> Column:
    """Claims from an array of JSON texts; each text is parsed once."""
    return typed_claims(F.transform(texts, F.try_parse_json))


def typed_claims(entries: Column) -> Column:
    """Claims from an array of variants."""
    return F.transform(entries, _claim)


def _claim(v: Column) -> Column:
    vt = F.coalesce(type_at(v, "$.value"), F.lit("VOID"))
    return F.struct(
        F.try_variant_get(v, "$.kind", "string").alias("kind"), F.try_variant_get(v, "$.t", "double").alias("t"),
        F.when(vt.rlike(TYPES["number"]), F.try_variant_get(v, "$.value", "double")).alias("value_num"),
        F.when(vt.rlike(TYPES["string"]), F.try_variant_get(v, "$.value", "string")).alias("value_str"),
    )
