"""Scores of alternative texts as one column expression without Python, and models' answers, which need a parser."""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from lectern.functions.text import strip

# Patterns of the scoring rules.
PLACEHOLDER = r"(?i)^(alt\s*text|description|image|photo|picture|graphic|untitled|placeholder|todo|tbd|fixme|replace\s+me|insert\s+(alt|description)|img_?\d+|image_?\d+|dsc_?\d+|screenshot_?\d+)\.?$"
FILE_NAME = r"(?i)^[\w\-./\\]+\.(png|jpg|jpeg|gif|bmp|svg|tiff?|webp|avif|ico)$"
PREFIX = r"(?i)^(image|picture|photo|graphic|icon|logo|illustration|diagram|screenshot|figure|img|pic)\s+(of|showing|depicting|displaying)\s+"
JUNK = r"[{}\[\]<>|\\]"
SPECIFIC = r"(?i)\b(chart|graph|table|map|form|button|link|menu|bar|pie|line|scatter|histogram|person|people|student|teacher|staff|building|campus|room|office|showing|displaying|containing|red|blue|green|yellow|orange|purple|black|white|left|right|top|bottom|center|labeled|titled|heading|section|percent|percentage|increase|decrease|trend|comparison)\b"


def flags(text: Column, context: Column | None = None) -> Column:
    """Array of (code, severity, deduction) structs, in order of the rules."""
    t = strip(F.coalesce(text, F.lit("")))
    n, words = F.length(t), F.regexp_count(t, F.lit(SPECIFIC))

    def flag(code: str, severity: str, deduction: int, when: Column) -> Column:
        return F.when(when, F.struct(F.lit(code).alias("code"), F.lit(severity).alias("severity"), F.lit(deduction).alias("deduction")))

    context = F.lit("") if context is None else F.coalesce(context, F.lit(""))
    found = F.array(
        flag("PLACEHOLDER", "error", 60, t.rlike(PLACEHOLDER)),
        flag("FILENAME", "error", 50, t.rlike(FILE_NAME)),
        flag("REDUNDANT_PREFIX", "warning", 10, t.rlike(PREFIX)),
        flag("TOO_SHORT", "warning", 15, n < 10),
        flag("SHORT", "info", 5, (n >= 10) & (n < 30)),
        flag("TOO_LONG", "warning", 10, n > 250),
        flag("LONG", "info", 3, (n > 125) & (n <= 250)),
        flag("JUNK_CHARS", "warning", 10, t.rlike(JUNK)),
        flag("LOW_SPECIFICITY", "info", 5, (words == 0) & (n >= 30)),
        flag("HIGH_SPECIFICITY", "info", 0, words >= 3),
        flag("REDUNDANT_CONTEXT", "warning", 15, (context != "") & F.contains(F.lower(context), F.lower(t))),
        flag("NO_CAPITAL", "info", 2, t.rlike(r"^\p{Ll}") & (n >= 20)),
    )
    missing = F.array(flag("MISSING", "error", 100, F.lit(True)))
    return F.when(t == "", missing).otherwise(F.filter(found, lambda x: x.isNotNull()))


def score(flag_array: Column) -> Column:
    total = F.aggregate(flag_array, F.lit(0), lambda a, x: a + x["deduction"])
    return F.greatest(F.lit(0), F.least(F.lit(100), F.lit(100) - total))


def rank(candidates: DataFrame, keys: list[str], order: str, text: str = "text") -> DataFrame:
    """``candidates`` with score and rank (best first; equal scores keep their order)."""
    scored = candidates.withColumn("score", score(flags(F.col(text))))
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), order)))


def advice(existing: Column, best: Column) -> Column:
    """What to do, from the existing text's score and the best candidate's (either may be null)."""
    alone = F.when(existing >= 80, "good").when(existing >= 60, "acceptable").otherwise("rewrite")
    both = F.when(existing >= best, "keep").when((existing >= 70) & (best - existing < 10), "close").otherwise("adopt")
    return F.when(best.isNull() & existing.isNull(), "").when(best.isNull(), alone).otherwise(both)


def _read_markup(markup: str) -> tuple[str | None, str | None, bool]:
    """Alternative text of the first image, text of the last caption, and whether there is an image."""
    seen: list[tuple[str, str, str | None]] = []
    reader = HTMLParser()
    reader.handle_starttag = lambda tag, attrs: seen.append(("start", tag, dict(attrs).get("alt", "")))
    reader.handle_endtag = lambda tag: seen.append(("end", tag, None))
    reader.handle_data = lambda data: seen.append(("data", "", data))
    reader.feed(markup)
    alts = [alt for kind, tag, alt in seen if (kind, tag) == ("start", "img") and alt is not None]
    if not alts:
        return None, None, False
    caption, words = "", None
    for kind, tag, data in seen:
        if (kind, tag) == ("start", "figcaption"):
            words = []
        elif (kind, tag) == ("end", "figcaption") and words is not None:
            caption, words = " ".join(words).strip(), None
        elif kind == "data" and words is not None:
            words.append(data)
    return alts[0].strip(), caption, True


def parsed(response: Column) -> Column:
    """A model's HTML answer, fenced or not, as a struct: alt, description, ok (false, and nulls, without an image)."""
    inside = F.regexp_extract(strip(response), r"(?s)^```(?:html)?\s*\n?(.*?)\n?\s*```$", 1)

    @F.pandas_udf("alt string, description string, ok boolean")
    def read(markup: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([_read_markup(m or "") for m in markup], columns=["alt", "description", "ok"])

    return read(F.when(inside != "", inside).otherwise(response))
