"""Column expressions with the rounding, casing and text rules the operators rely on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# ASCII punctuation, as a Java regex character class.
ASCII_PUNCT = r"""[!"#$%&'()*+,\-./:;<=>?@\[\\\]^_`{|}~]"""

# Score bounds of the three verdicts.
KEEP_AT = 62
KILL_AT = 45


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def held(df: DataFrame, **exprs: Column) -> DataFrame:
    """Add columns that are computed once per row: a generator keeps later filters and projections from repeating them."""
    return df.select("*", F.inline(F.array(F.struct(*[e.alias(n) for n, e in exprs.items()]))))


def half_up(c: Column | str) -> Column:
    """Round half toward +infinity (JavaScript rule); null stays null."""
    return F.floor(col(c) + F.lit(0.5))


def half_even(c: Column | str) -> Column:
    """Round half to even (Python rule) to a whole number."""
    return F.bround(col(c), 0).cast("bigint")


def fixed(c: Column | str, places: int) -> Column:
    """Fixed-point text of a double with half-even rounding on its decimal form."""
    d = F.bround(col(c).cast("decimal(38,12)"), places)
    return d.cast(f"decimal(38,{places})").cast("string")


def title_case(c: Column | str) -> Column:
    """Capital after every non-letter, lower case after a letter (``that's`` -> ``That'S``)."""
    chars = F.split(col(c), "")

    def capital(ch):
        # a letter may open with several capitals, of which only the first stays one
        return F.concat(F.substring(F.upper(ch), 1, 1), F.lower(F.substr(F.upper(ch), F.lit(2))))

    return F.array_join(
        F.transform(
            chars,
            lambda ch, i: F.when(
                (i > 0) & F.element_at(chars, F.greatest(i, F.lit(1))).rlike(r"\p{L}"), F.lower(ch)
            ).otherwise(capital(ch)),
        ),
        "",
    )


def capitalise(c: Column | str) -> Column:
    """Upper-case the first character, leave the rest alone."""
    c = col(c)
    return F.concat(F.upper(F.substring(c, 1, 1)), F.substr(c, F.lit(2)))


def rstrip(c: Column | str) -> Column:
    return F.regexp_replace(col(c), r"\s+$", "")


def strip(c: Column | str) -> Column:
    return F.regexp_replace(col(c), r"^\s+|\s+$", "")


def truncate_words(c: Column | str, cap: int) -> Column:
    """Text within ``cap`` stays; longer text is cut at a space and closed with an ellipsis."""
    c = col(c)
    head = rstrip(F.substring(c, 1, cap - 1))
    at_space = F.when(head.contains(" "), F.regexp_replace(head, r" [^ ]*$", "")).otherwise(head)
    return F.when(F.length(c) <= cap, c).otherwise(F.concat(rstrip(at_space), F.lit("…")))


def ends_sentence(c: Column | str) -> Column:
    """Word text closes a sentence, allowing closing quotes and brackets after the mark."""
    return col(c).rlike(r"""[.!?…]["'”’)\]}]*$""")


def squash(c: Column | str) -> Column:
    """Lower case, ASCII punctuation removed, white space collapsed."""
    bare = F.regexp_replace(F.lower(col(c)), ASCII_PUNCT, "")
    return F.trim(F.regexp_replace(bare, r"\s+", " "))


def verdict(total: Column | str) -> Column:
    total = col(total)
    return F.when(total >= KEEP_AT, "keep").when(total <= KILL_AT, "kill").otherwise("borderline")


def interval_iou(a0, a1, b0, b1) -> Column:
    """Overlap over union of two 1-D intervals; 0 when they do not overlap."""
    a0, a1, b0, b1 = (col(c) for c in (a0, a1, b0, b1))
    inter = F.least(a1, b1) - F.greatest(a0, b0)
    union = (a1 - a0) + (b1 - b0) - inter
    return F.when((inter > 0) & (union > 0), inter / union).otherwise(F.lit(0.0))




def p95(values: Column) -> Column:
    """Order statistic at ``int(0.95 * (n - 1))`` of an array, no interpolation."""
    s = F.array_sort(values)
    n = F.size(s)
    at = (F.floor(F.lit(0.95) * (n - 1)) + 1).cast("int")
    return F.when(n > 0, F.element_at(s, F.greatest(at, F.lit(1))))


def clock(c: Column | str) -> Column:
    """Seconds as ``m:ss``; negative or missing input reads ``0:00``."""
    c = col(c)
    bad = c.isNull() | F.isnan(c)
    s = F.when(bad, F.lit(0)).otherwise(F.greatest(F.lit(0), half_up(c)))
    return F.concat(F.floor(s / 60).cast("string"), F.lit(":"), F.lpad((s % 60).cast("string"), 2, "0"))


def subtitle_time(c: Column | str) -> Column:
    """Seconds as ``H:MM:SS.cc`` with half-even centiseconds."""
    cs = half_even(F.greatest(col(c), F.lit(0.0)) * 100)
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    return F.concat(
        F.floor(cs / 360000).cast("string"), F.lit(":"), two(F.floor(cs % 360000 / 6000)), F.lit(":"),
        two(F.floor(cs % 6000 / 100)), F.lit("."), two(cs % 100),
    )
