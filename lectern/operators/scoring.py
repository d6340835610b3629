"""Scores and grades of documents and of a corpus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Weights of the profiles.
CORE = {"error": 5.0, "warning": 2.0, "tip": 0.5}
CORE_UNKNOWN = 1.0
CONFIDENCE = {"error": {"high": 10, "medium": 7, "low": 3}, "warning": {"high": 3, "medium": 2, "low": 1}}
MARKDOWN = {"critical": 15, "serious": 7, "moderate": 3, "minor": 1}
# Least scores of A, B, C and D.
GRADES = {"tools": (90, 80, 70, 60), "core": (90, 80, 70, 50), "confidence": (90, 75, 50, 25), "markdown": (90, 75, 50, 25)}


def grade(score: Column, profile: str) -> Column:
    out = F.lit("F")
    for letter, least in reversed(list(zip("ABCD", GRADES[profile]))):
        out = F.when(score >= least, letter).otherwise(out)
    return out


def _penalty(profile: str) -> Column:
    severity = F.lower(F.col("severity"))
    if profile == "tools":
        errors, warnings = F.count_if(severity == "error"), F.count_if(severity == "warning")
        return F.least(10 * errors, F.lit(50)) + F.least(3 * warnings, F.lit(21))
    if profile == "core":
        severity = F.when(severity == "info", "tip").otherwise(severity)
        weight = F.lit(CORE_UNKNOWN)
        for name, w in CORE.items():
            weight = F.when(severity == name, F.lit(w)).otherwise(weight)
    elif profile == "confidence":
        weight = F.lit(0)
        for name, by in CONFIDENCE.items():
            for sure, w in by.items():
                weight = F.when((severity == name) & (F.lower(F.coalesce("confidence", F.lit("high"))) == sure), w).otherwise(weight)
    else:
        weight = F.lit(0)
        for name, w in MARKDOWN.items():
            weight = F.when(severity == name, w).otherwise(weight)
    return F.coalesce(F.sum(weight), F.lit(0))


def score_documents(findings: DataFrame, profile: str = "tools", key: str = "doc") -> DataFrame:
    """key, errors, warnings, infos, score, grade. One aggregation; a document is a group."""
    severity = F.lower(F.col("severity"))
    counted = findings.groupBy(key).agg(
        F.count_if(severity == "error").alias("errors"),
        F.count_if(severity == "warning").alias("warnings"),
        F.count_if(severity.isin("info", "tip")).alias("infos"),
        F.greatest(F.lit(0), F.floor(F.lit(100) - _penalty(profile))).cast("int").alias("score"),
    )
    return counted.withColumn("grade", grade(F.col("score"), profile))


def zero_unreadable(scored: DataFrame, documents: DataFrame, key: str = "doc") -> DataFrame:
    """``scored`` with score 0 and grade F for documents that could not be read (``access_ok`` false), whatever was found."""
    unread = documents.filter("not access_ok").select(F.col(key).alias("lectern_unread")).distinct()
    bad = F.col("lectern_unread").isNotNull()
    both = scored.join(unread, scored[key] == unread["lectern_unread"], "left")
    return both.withColumns({"score": F.when(bad, 0).otherwise(F.col("score")), "grade": F.when(bad, "F").otherwise(F.col("grade"))}).drop("lectern_unread")


def score_families(findings: DataFrame, documents: DataFrame, key: str = "doc") -> DataFrame:
    """family, key, errors, warnings, infos, score, grade: each family of rules by its own profile, never summed over families.

    Every document has a row per family that reads its type, 100 where nothing was found and 0 where it could not be read.
    """
    out = None
    for family, profile in (("core", "core"), ("tools", "tools")):
        read = documents.filter("type = 'pdf'") if family == "core" else documents
        rows = with_clean_documents(read.select(key, "access_ok"), score_documents(findings.filter(F.col("family") == family), profile, key), key, profile)
        rows = rows.select(F.lit(family).alias("family"), key, "errors", "warnings", "infos", "score", "grade")
        out = rows if out is None else out.unionByName(rows)
    return out


def with_clean_documents(documents: DataFrame, scored: DataFrame, key: str = "doc", profile: str = "tools") -> DataFrame:
    """All documents: those without findings score 100, those that could not be read (``access_ok`` false) 0."""
    out = documents.join(scored, key, "left").withColumn("score", F.when(~F.col("access_ok"), 0).otherwise(F.coalesce("score", F.lit(100))))
    return out.withColumn("grade", grade(F.col("score"), profile)).na.fill(0, ["errors", "warnings", "infos"])


def corpus_score(scored: DataFrame) -> DataFrame:
    """Mean score with banker's rounding, and its grade; (0, F) for no document."""
    value = F.coalesce(F.bround(F.avg("score")), F.lit(0)).cast("int")
    return scored.agg(F.count("*").alias("files"), value.alias("score")).withColumn("grade", grade(F.col("score"), "tools"))


def projected_score(score: Column, errors: Column, warnings: Column, tips: Column) -> Column:
    """The score after all repairs that the counts promise."""
    return F.least(F.lit(100), score + F.floor(5 * errors + 2 * warnings + 0.5 * tips)).cast("int")
