"""Parts of an audit over a findings table (the schema ``FINDING``): counts, plans, references and spreadsheet rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from lectern.functions.text import in_order
from lectern.operators import analytics
from lectern.operators.scoring import with_clean_documents
from lectern.plans import dims
from lectern.storage import small

# Groups of rules that one repair settles, in report order.
QUICK_FIXES = (
    ("tagging", ("PDFUA.STRUCT.TAGGED", "PDFUA.STRUCT.NOTREE")),
    ("title", ("PDFUA.METADATA.TITLE", "DOCX-META.TITLE", "PPTX.META.TITLE", "XLSX.META.TITLE", "EPUB-E001")),
    ("language", ("PDFUA.METADATA.LANG", "DOCX-META.LANG", "PPTX.META.LANG", "EPUB-E003")),
    ("form structure", ("PDFUA.FORM.STRUCT", "PDFBP.FORM.STRUCT")),
    ("tooltips", ("PDFUA.FORM.TU",)),
    ("slide titles", ("PPTX.SLIDE.TITLE",)),
    ("alternative text", ("DOCX-IMG.ALT", "PPTX.IMG.ALT", "XLSX.IMG.ALT", "EPUB-E009", "PDFUA.IMG.ALT")),
    ("table headers", ("PDFUA.TABLE.HEADERS", "DOCX-TABLE.HEADERS", "XLSX.TABLE.HEADER", "PPTX.TABLE.HEADER")),
    ("display title and tab order", ("PDFBP.DISPLAY.DOCTITLE", "PDFBP.NAV.TABORDER")),
)
# Rules that every document gets, so that they say nothing about it.
ALWAYS_ON = ("PDFQ.ORDER.MANUAL", "PPTX.ORDER.VERIFY")
# Criteria that are not of level A.
LEVELS = {"1.4.3": "AA", "2.4.5": "AA", "2.4.6": "AA", "2.3.3": "AAA"}
UNDERSTANDING = "https://www.w3.org/WAI/WCAG22/Understanding/"


def severity_counts(findings: DataFrame, *keys: str) -> DataFrame:
    """Counts by severity, each spelling of its own; a missing one counts as Info."""
    return findings.groupBy(*keys, F.coalesce("severity", F.lit("Info")).alias("severity")).agg(F.count("*").alias("n"))


def by_severity(findings: DataFrame) -> DataFrame:
    """errors, warnings and the rest, whatever the spelling, of each document."""
    level = F.lower(F.coalesce("severity", F.lit("info")))
    return findings.groupBy("doc").agg(F.count_if(level == "error").alias("errors"), F.count_if(level == "warning").alias("warnings"), F.count_if(~level.isin("error", "warning")).alias("others"))


def summary(findings: DataFrame) -> DataFrame:
    """One row per file type, those without findings too; a missing type is ``unknown``."""
    level = F.lower(F.coalesce("severity", F.lit("info")))
    seen = findings.select(F.coalesce("type", F.lit("unknown")).alias("type"), "doc", level.alias("level"))
    zero = findings.sparkSession.createDataFrame([(t,) for t in dims.TYPES], "type string")
    every = seen.unionByName(zero, allowMissingColumns=True)
    return every.groupBy("type").agg(F.count_distinct("doc").alias("files"), F.count("doc").alias("findings"), F.count_if(F.col("level") == "error").alias("errors"), F.count_if(F.col("level") == "warning").alias("warnings"))


def quick_fixes(findings: DataFrame, total: int | Column) -> DataFrame:
    """The groups of ``QUICK_FIXES`` that any file needs, numbered in their order: number, title, files, total."""
    rows = [(i, title, rule) for i, (title, rules) in enumerate(QUICK_FIXES) for rule in rules]
    groups = findings.sparkSession.createDataFrame(rows, "position int, title string, rule string")
    return analytics.quick_fixes(findings, groups).withColumn("total", F.lit(total) if isinstance(total, int) else total)


def file_inventory(findings: DataFrame) -> DataFrame:
    """Each document's findings, gravest first, then by rule: doc, place, severity, rule, message."""
    order = Window.partitionBy("doc").orderBy(in_order(F.col("severity"), "level"), "rule", "ord", "message")
    return findings.withColumn("place", F.row_number().over(order)).select("doc", "place", "severity", "rule", "message")


def rule_reference(findings: DataFrame, rules: DataFrame) -> DataFrame:
    """The rules met, with their standard and criterion, by catalogue severity and id; other severities last."""
    met = findings.select("rule").distinct().join(small(rules), "rule", "left")  # 131 rules
    place = in_order(F.col("catalog_severity"), "level")
    return met.select("rule", "standard", "criterion", "catalog_severity", F.row_number().over(Window.orderBy(place, "rule")).alias("place"))


def manual_review(findings: DataFrame) -> DataFrame:
    """Rules about reading order that were detected and do not apply to every document: rule, severity, files."""
    wanted = findings.filter(F.col("rule").isin(*dims.READING_ORDER) & ~F.col("rule").isin(*ALWAYS_ON))
    return wanted.groupBy("rule", "severity").agg(F.count_distinct("doc").alias("files"))


def remediation_results(files: DataFrame) -> DataFrame:
    """``files`` (doc, before, after, fixed, remaining, needs_human) with the change as text, and a row of totals (doc null).

    A missing score gives N/A.
    """
    delta = F.col("after") - F.col("before")
    change = F.when(delta.isNull(), "N/A").when(delta > 0, F.concat(F.lit("+"), delta.cast("string"))).otherwise(delta.cast("string"))
    counts = ("fixed", "remaining", "needs_human")
    rows = files.select("doc", "before", "after", change.alias("change"), *(F.col(c).cast("long").alias(c) for c in counts))
    return rows.unionByName(files.agg(*(F.sum(c).cast("long").alias(c) for c in counts)), allowMissingColumns=True)


def baseline_match(before: DataFrame, after: DataFrame, key: str = "path") -> DataFrame:
    """Files of two audits by path: in both, or in one only."""
    a = before.select(key).distinct().withColumn("was", F.lit(True))
    b = after.select(key).distinct().withColumn("now", F.lit(True))
    return a.join(b, key, "full_outer").select(key, F.when(F.col("now").isNull(), "only before").when(F.col("was").isNull(), "only after").otherwise("both").alias("found"))


def pattern_types(findings: DataFrame, total: int | Column) -> DataFrame:
    """Per rule: Systemic (in all files), Template (three or more) or File-specific."""
    rows = analytics.patterns(findings, total)
    return rows.select("rule", "files", F.when(F.col("pattern") == "systemic", "Systemic").when(F.col("files") >= 3, "Template").otherwise("File-specific").alias("pattern_type"))


def priority(severity: Column, pattern: Column) -> Column:
    """Immediate, Soon or When Possible from severity and pattern type."""
    level, systemic = F.lower(severity), pattern == "Systemic"
    return F.when((level == "error") & (systemic | (pattern == "Template")), "Immediate").when((level == "error") | ((level == "warning") & systemic), "Soon").otherwise("When Possible")


def effort(fix: Column, tier: Column) -> Column:
    return F.when(tier == 1, "Low").when(tier == 2, "Medium").otherwise("High")


def criterion_url(spark: SparkSession) -> DataFrame:
    """criterion, level and link of each success criterion (20 rows)."""
    level = F.lit("A")
    for criterion, value in LEVELS.items():
        level = F.when(F.col("criterion") == criterion, value).otherwise(level)
    slug = F.regexp_replace(F.regexp_replace(F.lower("name"), r"[^a-z\- ]", ""), " ", "-")
    return dims.criterion_dim(spark).select(F.col("criterion").alias("wcag_criteria"), level.alias("wcag_level"), F.concat(F.lit(UNDERSTANDING), slug).alias("wcag_url"))


_EMPTY = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
# Columns of the spreadsheets, in order.
FINDING_COLUMNS = ("finding_id", "file_path", "file_type", "severity", "confidence", "score_impact", "rule_id", "wcag_criteria", "wcag_level", "issue_summary", "location", "pattern_type", "remediation_status", "fix_suggestion", "help_url", "wcag_url")
SCORECARD_COLUMNS = ("file_path", "file_type", "file_size_kb", "score", "grade", "error_count", "warning_count", "tip_count", "total_issues", "template_name", "has_title", "has_language", "audit_date", "compliance_standard")
REMEDIATION_COLUMNS = ("priority", "rule_id", "issue_summary", "file_type", "affected_files", "total_instances", "pattern_type", "wcag_criteria", "severity", "estimated_effort", "fix_steps", "help_url", "wcag_url", "roi_score")
MD_FINDING_COLUMNS = ("finding_id", "file_path", "line_number", "severity", "confidence", "score_impact", "wcag_criteria", "wcag_level", "domain", "rule_id", "issue_summary", "content", "pattern_type", "remediation_status", "auto_fixable", "fix_suggestion", "wcag_url")
MD_SCORECARD_COLUMNS = ("file_path", "score", "grade", "critical_count", "serious_count", "moderate_count", "minor_count", "total_issues", "systemic_issues", "file_specific_issues", "auto_fixable", "manual_review", "audit_date")
MD_REMEDIATION_COLUMNS = ("priority", "domain", "rule_id", "issue_summary", "affected_files", "total_instances", "pattern_type", "wcag_criteria", "severity", "estimated_effort", "auto_fixable", "fix_guidance", "wcag_url", "roi_score")


def _numbered(findings: DataFrame, prefix: str) -> DataFrame:
    """``finding_id``: document and place in it, so that no task must see all findings."""
    place = F.row_number().over(Window.partitionBy("doc").orderBy("ord", "message"))
    return findings.withColumn("finding_id", F.concat(F.lit(prefix), F.col("doc").cast("string"), F.lit("-"), F.lpad(place.cast("string"), 3, "0")))


def csv_findings(findings: DataFrame, files: DataFrame, total: int | Column, status: DataFrame | None = None) -> DataFrame:
    """One row of texts per finding. ``files``: doc, path; ``status``: doc, rule, status (else New)."""
    spark = findings.sparkSession
    rows = _numbered(findings, "DOC-").join(files.select("doc", F.col("path").alias("file_path")), "doc", "left").join(pattern_types(findings, total).drop("files"), "rule")
    rows = rows.withColumn("wcag_criteria", F.col("wcag")).join(small(criterion_url(spark)), "wcag_criteria", "left")
    rows = rows.join(status.withColumnRenamed("status", "remediation_status"), ["doc", "rule"], "left") if status is not None else rows.withColumn("remediation_status", F.lit(None).cast("string"))
    impact = F.when(F.lower("severity") == "error", "-10").when(F.lower("severity") == "warning", "-3").otherwise("0")
    place = F.concat_ws(", ", F.concat(F.lit("Page "), "page"), F.concat(F.lit("Line "), "line"), "element")
    rows = rows.withColumns({"file_type": F.upper("type"), "score_impact": impact, "rule_id": F.col("rule"), "issue_summary": F.col("message"), "location": place, "remediation_status": F.coalesce("remediation_status", F.lit("New")), "fix_suggestion": F.coalesce("fix", F.lit("manual")), "help_url": F.col("wcag_url")})
    return rows.select(*map(_EMPTY, FINDING_COLUMNS))


def csv_scorecard(scored: DataFrame, files: DataFrame, audit_date: str) -> DataFrame:
    """One row of texts per document. ``files``: doc, path, type, size_bytes, title, lang; access_ok; documents without findings score 100, those that could not be read 0."""
    yes = lambda c: F.when(F.trim(F.coalesce(c, F.lit(""))) == "", "No").otherwise("Yes")
    rows = with_clean_documents(files, scored)
    rows = rows.withColumns({"file_path": F.col("path"), "file_type": F.upper("type"), "file_size_kb": F.ceil(F.col("size_bytes") / 1024), "error_count": F.col("errors"), "warning_count": F.col("warnings"), "tip_count": F.col("infos"), "total_issues": F.col("errors") + F.col("warnings") + F.col("infos"), "template_name": F.lit(""), "has_title": yes(F.col("title")), "has_language": yes(F.col("lang")), "audit_date": F.lit(audit_date), "compliance_standard": F.lit("WCAG 2.2 AA")})
    return rows.select(*map(_EMPTY, SCORECARD_COLUMNS))


def csv_remediation(findings: DataFrame, total: int | Column, tiers: DataFrame) -> DataFrame:
    """One row of texts per rule and severity, with priority, effort and worth of the repair."""
    weight = F.when(F.lower("severity") == "error", 10).when(F.lower("severity") == "warning", 5).otherwise(1)
    # texts are keys, not aggregates, and documents are counted by themselves: neither then sorts the findings
    said = findings.groupBy("rule", "severity", "type", "wcag", "fix").agg(F.count("*").alias("n"))
    files = findings.groupBy("rule", "severity").agg(F.count_distinct("doc").alias("affected_files"))
    both = said.unionByName(files, allowMissingColumns=True)
    rows = both.groupBy("rule", "severity").agg(F.array_join(F.array_sort(F.collect_set(F.upper("type"))), ", ").alias("file_type"), F.max("affected_files").alias("affected_files"), F.sum("n").alias("total_instances"), F.min("wcag").alias("wcag_criteria"), F.min("fix").alias("fix"))
    rows = rows.join(pattern_types(findings, total).drop("files"), "rule").join(small(tiers.select("rule", "tier")), "rule", "left").join(small(criterion_url(findings.sparkSession)), "wcag_criteria", "left")
    rows = rows.withColumns({"priority": priority(F.col("severity"), F.col("pattern_type")), "rule_id": F.col("rule"), "issue_summary": F.col("rule"), "estimated_effort": effort(F.col("fix"), F.col("tier")), "fix_steps": F.coalesce("fix", F.lit("manual")), "help_url": F.col("wcag_url"), "roi_score": F.col("total_instances") * weight})
    return rows.select(*map(_EMPTY, REMEDIATION_COLUMNS))


def md_level(severity: Column) -> Column:
    """The Markdown scale of a severity."""
    return F.when(F.lower(severity) == "error", "Serious").when(F.lower(severity) == "warning", "Moderate").otherwise("Minor")


def _md(findings: DataFrame) -> DataFrame:
    """Markdown findings with their scale, domain, pattern and link; an issue in three or more files is systemic."""
    files = findings.groupBy("rule").agg(F.count_distinct("doc").alias("affected_files"))
    rows = findings.withColumn("level", md_level(F.col("severity"))).join(files, "rule").withColumn("wcag_criteria", F.col("wcag")).join(small(criterion_url(findings.sparkSession)), "wcag_criteria", "left")
    pattern = F.when(F.col("affected_files") >= 3, "Systemic").otherwise("File-specific")
    return rows.withColumns({"pattern_type": pattern, "domain": F.initcap(F.element_at(F.split("rule", r"\."), 2)), "auto_fixable": F.when(F.col("fix").isNull(), "No").otherwise("Yes")})


def md_csv_findings(findings: DataFrame, files: DataFrame) -> DataFrame:
    rows = _md(_numbered(findings, "MD-")).join(files.select("doc", F.col("path").alias("file_path")), "doc", "left")
    impact = F.when(F.col("level") == "Serious", "-7").when(F.col("level") == "Moderate", "-3").otherwise("-1")
    rows = rows.withColumns({"line_number": F.col("line"), "severity": F.col("level"), "score_impact": impact, "rule_id": F.col("rule"), "issue_summary": F.col("message"), "content": F.col("element"), "remediation_status": F.lit("New"), "fix_suggestion": F.coalesce("fix", F.lit("manual"))})
    return rows.select(*map(_EMPTY, MD_FINDING_COLUMNS))


def md_csv_scorecard(findings: DataFrame, files: DataFrame, audit_date: str) -> DataFrame:
    count = lambda c, v: F.count_if(F.col(c) == v)
    weight = F.when(F.col("level") == "Critical", 15).when(F.col("level") == "Serious", 7).when(F.col("level") == "Moderate", 3).otherwise(1)
    each = _md(findings).groupBy("doc").agg(F.greatest(F.lit(0), 100 - F.sum(weight)).alias("score"), *(count("level", x).alias(f"{x.lower()}_count") for x in ("Critical", "Serious", "Moderate", "Minor")), F.count("*").alias("total_issues"), count("pattern_type", "Systemic").alias("systemic_issues"), count("pattern_type", "File-specific").alias("file_specific_issues"), count("auto_fixable", "Yes").alias("auto_fixable"), count("auto_fixable", "No").alias("manual_review"))
    rows = files.select("doc", F.col("path").alias("file_path")).join(each, "doc", "left").na.fill(100, ["score"]).na.fill(0)
    from lectern.operators.scoring import grade

    return rows.withColumns({"grade": grade(F.col("score"), "markdown"), "audit_date": F.lit(audit_date)}).select(*map(_EMPTY, MD_SCORECARD_COLUMNS))


def md_csv_remediation(findings: DataFrame) -> DataFrame:
    """One row per rule, worthiest first (priority 1); the order of the few rules is one small window."""
    weight = F.when(F.col("level") == "Critical", 10).when(F.col("level") == "Serious", 7).when(F.col("level") == "Moderate", 3).otherwise(1)
    rows = _md(findings).groupBy("rule", "domain", "level", "pattern_type", "affected_files", "wcag_criteria", "wcag_url", "auto_fixable").agg(F.count("*").alias("total_instances"))
    rows = rows.withColumn("roi_score", F.col("total_instances") * weight)
    place = F.row_number().over(Window.orderBy(F.desc("roi_score"), "rule", "level"))
    rows = rows.withColumns({"priority": place, "rule_id": F.col("rule"), "issue_summary": F.col("rule"), "severity": F.col("level"), "estimated_effort": F.when(F.col("auto_fixable") == "Yes", "Low").otherwise("High"), "fix_guidance": F.lit("manual")})
    return rows.select(*map(_EMPTY, MD_REMEDIATION_COLUMNS))


def tier_badges(findings: DataFrame, tiers: DataFrame, total: int | Column) -> DataFrame:
    """One line per repair tier: how the tier's rules are settled, how many files they touch, and which they are."""
    known = findings.join(small(tiers.select("rule", "tier")), "rule")
    # a text is no aggregate beside counted documents: they would be sorted for it
    both = known.select("tier", "rule").distinct().unionByName(known.groupBy("tier").agg(F.count_distinct("doc").alias("files")), allowMissingColumns=True)
    rows = both.groupBy("tier").agg(F.max("files").alias("files"), F.array_join(F.array_sort(F.collect_set("rule")), ", ").alias("rules"))
    name = F.when(F.col("tier") == 1, "Automated").when(F.col("tier") == 2, "Assisted").otherwise("Manual")
    whole = F.lit(total) if isinstance(total, int) else total
    return rows.select("tier", F.concat(name, F.lit(": "), F.col("files").cast("string"), F.lit(" of "), whole.cast("string"), F.lit(" files: "), "rules").alias("badge"))


def chosen_models(asked: Column, allowed: tuple[str, ...], default: str, most: int = 5) -> Column:
    """Models of a request, each once in order, or why not: struct(models, error)."""
    once = F.array_distinct(F.coalesce(asked, F.array().cast("array<string>")))
    unknown = F.filter(once, lambda m: ~m.isin(*allowed))
    error = F.when(F.size(once) > most, F.concat(F.lit("too many models: "), F.size(once).cast("string"))).when(F.size(unknown) > 0, F.concat(F.lit("unknown models: "), F.array_join(unknown, ", ")))
    return F.struct(F.when(error.isNull(), F.when(F.size(once) == 0, F.array(F.lit(default))).otherwise(once)).alias("models"), error.alias("error"))


def error_type(parsed: Column, status: Column) -> Column:
    """parse, rate_limit or api; null where a model answered well."""
    return F.when(status == 429, "rate_limit").when(status >= 400, "api").when(~parsed, "parse")


def pixels(points: Column, dpi: Column, zoom: Column) -> Column:
    """PDF points as pixels; the zoom is kept between 0.5 and 4."""
    return points * dpi / 72 * F.greatest(F.lit(0.5), F.least(F.lit(4.0), zoom))


def confidence_weight(confidence: Column) -> Column:
    """1.0, 0.7 or 0.3 for high (or none), medium and low confidence."""
    level = F.lower(F.coalesce(confidence, F.lit("high")))
    return F.when(level == "high", 1.0).when(level == "medium", 0.7).otherwise(0.3)


def tool_errors(docs: DataFrame) -> DataFrame:
    """A ``TOOL.FILE`` error for each document that the validator could not be given."""
    bad = docs.filter(~F.col("access_ok"))
    return bad.select(F.col("doc_id").alias("doc"), "type", F.lit("TOOL.FILE").alias("rule"), F.lit("error").alias("severity"), F.lit("high").alias("confidence"), F.coalesce("skip_reason", F.lit("not readable")).alias("message"))


def write_saved(findings: DataFrame, path: str) -> None:
    """One JSON audit per document: doc, type and its findings."""
    each = findings.groupBy("doc", "type").agg(F.array_sort(F.collect_list(F.struct("ord", "rule", "severity", "message", "page", "line"))).alias("findings"))
    each.write.mode("overwrite").json(path)


def read_saved(spark: SparkSession, path: str) -> DataFrame:
    """Findings of saved audits, one row each; a document without findings gives none."""
    schema = "doc bigint, type string, findings array<struct<ord:bigint,rule:string,severity:string,message:string,page:int,line:int>>"
    return spark.read.schema(schema).json(path).select("doc", F.coalesce("type", F.lit("unknown")).alias("type"), F.inline("findings"))
