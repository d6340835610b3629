"""Parts of an audit report as tables: strengths, estimates, scorecards, form and tag inventories, narratives."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from lectern.functions.text import is_blank
from lectern.storage import small
from lectern.operators.scoring import grade

# What an overall grade says; F stands for D too.
STATUS = {
    "A": "Excellent — meets or exceeds most accessibility requirements",
    "B": "Good foundation — minor issues need attention",
    "C": "Adequate foundation, moderate fixes required",
    "F": "Significant barriers found — remediation needed before publishing",
}
EFFORT = {"A": "Minimal", "B": "Low", "C": "Moderate", "F": "High"}
# Severities that each scan profile keeps.
PROFILES = {"strict": ("Error", "Warning", "Tip", "Info"), "moderate": ("Error", "Warning"), "minimal": ("Error",)}
# Tasks that every file needs, with minutes.
ALWAYS = {"Manual reading order review": 10, "Run accessibility checks": 5}
# Tags that need no alternative text of their own.
PLAIN_TAGS = ("Document", "StructTreeRoot", "P", "H1", "H2", "H3", "H4", "H5", "H6", "Span", "Table", "TR", "TH", "TD", "L", "LI", "LBody", "Figure", "Form", "Link", "Sect", "Part", "Art", "Div", "BlockQuote", "Quote", "Note", "Caption", "Label")
# Rule, severity and words of the key problems of one document; {n} is the rule's number of findings.
PROBLEMS = (
    ("PDFUA.TITLE", "error", "missing document title"),
    ("PDFBP.NO_HEADINGS", "warning", "no heading structure"),
    ("PDFBP.NONSTD_NO_ALT", "warning", "{n} non-standard elements without alt text"),
    ("PDFBP.TABLE_SCOPE", "warning", "table header cells without scope attributes (x{n})"),
    ("PDFBP.FORMS_DETACHED", "error", "form fields detached from their labels in reading order"),
    ("PDFUA.FORMS", "error", "{n} form field(s) missing tooltips"),
)


def _by_grade(values: dict[str, str], letter: Column) -> Column:
    out = F.lit(values["F"])
    for key in "ABC":
        out = F.when(letter == key, values[key]).otherwise(out)
    return out


def assessment(corpus: DataFrame) -> DataFrame:
    """``corpus`` (score, grade) with the status and effort that its grade stands for."""
    return corpus.withColumn("status", _by_grade(STATUS, F.col("grade"))).withColumn("effort", _by_grade(EFFORT, F.col("grade")))


def profile(findings: DataFrame, name: str) -> DataFrame:
    """Findings that a scan profile reports; a missing severity counts as Info."""
    return findings.filter(F.coalesce("severity", F.lit("Info")).isin(*PROFILES[name]))


def strengths(documents: DataFrame, findings: DataFrame, statements: DataFrame) -> DataFrame:
    """Statements (position, title, rule, type) that hold: no error of their rules, and their type, if any, occurs."""
    errors = findings.filter("severity = 'Error'").select("rule").distinct()
    failing = statements.join(errors, "rule", "left_semi").select("position")
    held = statements.select("position", "title", "type").distinct().join(failing, "position", "left_anti")
    present = documents.select(F.col("type").alias("present")).distinct()
    return held.join(present, F.col("type") == F.col("present"), "left").filter("type is null or present is not null").select("position", "title")


def time_estimates(documents: DataFrame, findings: DataFrame, tasks: DataFrame) -> DataFrame:
    """task, files, least and most minutes.

    ``tasks``: task, rule, shows (whether this rule alone brings the task up), least, most, each
    (minutes are per file). Two tasks that all documents need follow.
    """
    needed = findings.join(small(tasks), "rule").groupBy("task", "least", "most", "each").agg(F.count_distinct("doc").alias("files"), F.max("shows").alias("shown")).filter("shown")
    minutes = lambda c: (F.when(F.col("each"), F.col("files") * F.col(c)).otherwise(F.col(c))).cast("long").alias(c)
    total = documents.agg(F.count("*").alias("files"))
    rest = total.select(F.explode(F.array(*(F.struct(F.lit(task).alias("task"), F.lit(m).alias("m")) for task, m in ALWAYS.items()))).alias("t"), "files")
    always = (F.col("files") * F.col("t.m")).cast("long")
    return needed.select("task", "files", minutes("least"), minutes("most")).union(rest.select("t.task", "files", always, always))


def scorecard(scored: DataFrame) -> DataFrame:
    """Files, the mean score as it is, and the best and the worst document (the least id where several are)."""
    return scored.agg(F.count("*").alias("files"), F.avg("score").alias("mean"), F.min_by("doc", F.struct(-F.col("score"), F.col("doc"))).alias("best"), F.min_by("doc", F.struct("score", "doc")).alias("worst"))


def ranking(scored: DataFrame, key: str) -> DataFrame:
    """Per ``key``: files, mean errors a file, and the file with most errors."""
    return scored.groupBy(key).agg(F.count("*").alias("files"), F.avg("errors").alias("mean_errors"), F.min_by("doc", F.struct(-F.col("errors"), F.col("doc"))).alias("worst"))


def file_totals(scored: DataFrame) -> DataFrame:
    """One row per document and one of all (doc null), in one pass."""
    rows = scored.groupingSets([["doc"], []], "doc").agg(F.sum("errors").alias("errors"), F.sum("warnings").alias("warnings"), F.bround(F.avg("score")).cast("int").alias("score"), (F.grouping("doc") == 1).alias("overall"))
    return rows.withColumn("grade", grade(F.col("score"), "tools"))


def form_summary(fields: DataFrame) -> DataFrame:
    """Per document: fields, with and without tooltip, without name, required ones, and the types with their counts."""
    counted = fields.withColumn("ft", F.coalesce("ft", F.lit("Unknown"))).groupBy("doc_id", "ft").agg(F.count("*").alias("n"), F.count_if(is_blank(F.col("tooltip"))).alias("bare"), F.count_if(is_blank(F.col("name"))).alias("nameless"), F.count_if(F.col("ff").bitwiseAND(2) != 0).alias("required"))
    types = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ft", "n"))), lambda x: F.concat(x["ft"], F.lit(":"), x["n"])), ",")
    got = counted.groupBy("doc_id").agg(F.sum("n").alias("total"), F.sum("bare").alias("missing_tooltip"), F.sum("nameless").alias("missing_name"), F.sum("required").alias("required"), types.alias("types"))
    return got.withColumn("has_tooltips", F.col("total") - F.col("missing_tooltip"))


def tag_inventory(nodes: DataFrame, role_map: DataFrame) -> DataFrame:
    """Elements of unusual or mapped tags without any alternative text, numbered per document from 0."""
    roles = role_map.select("doc_id", "tag", "maps_to").dropDuplicates(["doc_id", "tag"])
    rows = nodes.join(roles, ["doc_id", "tag"], "left").filter(F.col("maps_to").isNotNull() | ~F.col("tag").isin(*PLAIN_TAGS))
    bare = is_blank(F.col("alt")) & is_blank(F.col("actual_text"))
    number = F.row_number().over(Window.partitionBy("doc_id").orderBy("preorder")) - 1
    action = F.when(F.col("tag") == "InlineShape", "Mark as decorative artifact").otherwise("Add alt text or change type")
    return rows.filter(bare).select("doc_id", number.alias("number"), "page", "tag", F.coalesce("maps_to", F.lit("")).alias("maps_to"), action.alias("action"))


def key_problems(findings: DataFrame, problems: tuple[tuple[str, str, str], ...] = PROBLEMS) -> DataFrame:
    """Per document its key problems, as a text in the order of ``problems``; null where it has none of them."""
    severity = F.lower("severity")
    counts = [c for i, (rule, level, _) in enumerate(problems) for c in (F.count_if(F.col("rule") == rule).alias(f"n{i}"), F.max((F.col("rule") == rule) & (severity == level)).alias(f"has{i}"))]
    said = [F.when(F.col(f"has{i}"), F.replace(F.lit(words), F.lit("{n}"), F.col(f"n{i}").cast("string"))) for i, (_, _, words) in enumerate(problems)]
    return findings.groupBy("doc").agg(*counts).select("doc", F.nullif(F.concat_ws(", ", *said), F.lit("")).alias("problems"))


def inventory(files: DataFrame, *keys: str) -> DataFrame:
    """Per folder, type or whatever ``keys`` say: files, and those without a title or a language."""
    without = lambda c: F.count_if(is_blank(F.col(c)))
    return files.groupBy(*keys).agg(F.count("*").alias("files"), without("title").alias("untitled"), without("lang").alias("no_language"))
