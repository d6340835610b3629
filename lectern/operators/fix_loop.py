"""Planned repairs applied to the fact tables, and the scan, plan, patch, rescan loop over them.

A patch is a row: table, document, key inside the document, field, value and place in the order of
writers. Input files stay as they are; what a repaired file would say are new fact tables, so the rules
that found the faults judge the repairs. All steps are joins on (document, key) and one grouping of the
patches; nothing is gathered but the few patches of one key.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from lectern.operators import scoring
from lectern.plans import fixes, rules
from lectern.sources.schema import SCHEMAS
from lectern.storage import by_documents, stored, table_by

# What each repair writes: tool, rule, table, field, and the value where it is not the plan's.
WRITES: list[tuple[str, str, str, str, str | None]] = [
    ("fix_pdf", "PDFUA.METADATA.TITLE", "doc", "title", None),
    ("fix_pdf", "PDFUA.METADATA.LANG", "doc", "lang", None),
    ("fix_pdf", "PDFUA.METADATA.DISPLAY_TITLE", "doc", "display_doc_title", "true"),
    ("fix_pdf", "PDFUA.METADATA.DISPLAY_TITLE", "doc", "viewer_prefs_present", "true"),
    ("fix_pdf", "PDFUA.METADATA.PDFUA_ID", "doc", "xmp", "<pdfuaid:part>1"),
    ("fix_pdf", "PDFUA.STRUCTURE.MARKED", "doc", "tagged", "true"),
    ("fix_pdf", "PDFUA.STRUCTURE.MARKED", "doc", "mark_info_present", "true"),
    ("fix_pdf", "PDFUA.NAV.TAB_ORDER", "pdf_page", "tabs", None),
    ("fix_pdf", "PDFUA.FORM.TU", "form_field", "tooltip", None),
    ("fix_word", "DOCX-META.TITLE", "doc", "title", None),
    ("fix_word", "DOCX-META.AUTHOR", "doc", "author", None),
    ("fix_word", "DOCX-META.LANG", "doc", "lang", None),
    ("fix_word", "DOCX-TABLE.HEADERS", "doc_table", "has_header", "true"),
    ("fix_excel", "XLSX-META.TITLE", "doc", "title", None),
    ("fix_excel", "XLSX-META.AUTHOR", "doc", "author", None),
    ("fix_pptx", "PPTX-META.TITLE", "doc", "title", None),
    ("fix_pptx", "PPTX-META.AUTHOR", "doc", "author", None),
    ("fix_pptx", "PPTX-SLIDE.TITLE", "slide", "title", None),
    ("fix_pptx", "PPTX-SLIDE.TITLE_UNIQUE", "slide", "title", None),
    ("fix_epub", "EPUB-E001", "epub_pkg", "title", None),
    ("fix_epub", "EPUB-E003", "epub_pkg", "language", None),
    ("fix_epub", "EPUB-T002", "epub_pkg", "creator", None),
    ("fix_epub", "EPUB-E004", "epub_pkg", "nav_present", "true"),
    ("fix_epub", "EPUB-E004", "epub_pkg", "nav_types", "toc"),
    ("fix_epub", "EPUB-E007", "epub_pkg", "metas", None),
    ("fix_epub", "EPUB-E006", "epub_spine", "", None),
    ("fix_epub", "EPUB-W003", "html_el", "el", None),
    ("fix_epub", "EPUB-E005", "html_el", "attrs", None),
]
#: What tells the rows of a table apart inside a document; none: a document is a row.
KEYS: dict[str, tuple[str, ...]] = {"doc": (), "epub_pkg": (), "pdf_page": ("page",), "form_field": ("ord",), "doc_table": ("table_no",), "slide": ("slide_no",), "epub_spine": ("ord",), "html_el": ("content_doc", "nth")}


def patches(spark: SparkSession, plan: DataFrame) -> DataFrame:
    """table, doc_id, content_doc, number, field, value, seq of each write that a plan's ``fixed`` rows make.

    ``target`` ends in the number of the part it names, after the content document where there is one.
    Planned rows that no fact tells of (print titles) and those left to a person write nothing.
    """
    writes = [(*w, i) for i, w in enumerate(WRITES)]
    known = spark.createDataFrame(writes, "tool string, rule string, table string, field string, given string, seq int")
    number = F.expr("try_cast(regexp_extract(target, '([0-9]+)$', 1) AS int)")
    place = F.regexp_extract("target", "^(.*) (?:heading|element) [0-9]+$", 1)
    value = F.when(F.col("field") == "metas", F.concat_ws("=", "target", "new")).otherwise(F.coalesce("given", "new"))
    rows = plan.filter("status = 'fixed'").join(F.broadcast(known), ["tool", "rule"])  # a row per write
    return rows.select("table", F.col("doc").alias("doc_id"), place.alias("content_doc"), number.alias("number"), "field", value.alias("value"), "seq")


def patched(table: DataFrame, name: str, changes: DataFrame, files: int | None = None) -> DataFrame:
    """The table with its patches applied: the last writer of a field wins (largest ``seq``, ties: largest value).

    A null value changes nothing. Arrays are added to, in the order of writers; a patch without a field drops the row.
    Rows without a patch stay as they are, as do rows with a null document or key; rows with equal keys change alike.
    A table that lies by documents in ``files`` files is not moved: the patches are brought to it.
    """
    keys = ["doc_id", *KEYS[name]]
    rows = table
    mine = changes.filter((F.col("table") == name) & F.col("value").isNotNull())
    for k in KEYS[name]:
        if k != "content_doc":
            mine = mine.withColumn(k, F.col("number"))
    if name == "html_el":  # plans number headings among themselves, other elements by their place
        heads = table.filter("el rlike '^h[1-6]$'").select("doc_id", "content_doc", "ord", F.row_number().over(Window.partitionBy("doc_id", "content_doc").orderBy("ord")).alias("nth"))
        named = mine.filter("field = 'el'").join(heads, ["doc_id", "content_doc", "nth"])
        mine = named.unionByName(mine.filter("field <> 'el'").withColumn("ord", F.col("number")))
        mine = mine.repartition(files, "doc_id") if files else mine
        keys = ["doc_id", "content_doc", "ord"]
    kinds = {f.name: f.dataType for f in table.schema.fields}
    fields = sorted({f for _, _, t, f, _ in WRITES if t == name and f})
    arrays = [f for f in fields if kinds[f].typeName() == "array"]
    is_ = lambda f: F.col("field") == f
    last = [F.max(F.when(is_(f), F.struct("seq", "value")))["value"].alias(f"new_{f}") for f in fields if f not in arrays]
    added = [F.transform(F.array_sort(F.collect_list(F.when(is_(f), F.struct("seq", "value")))), lambda x: x["value"]).alias(f"new_{f}") for f in arrays]
    news = mine.groupBy(*keys).agg(*last, *added, F.count_if(is_("")).alias("dropped"))
    both = rows.join(news, keys, "left").filter("coalesce(dropped, 0) = 0")

    def now(f: str):
        if f not in fields:
            return F.col(f)
        if f in arrays:
            new = F.coalesce(F.col(f"new_{f}"), F.array().cast("array<string>"))
            if f == "metas":
                new = F.transform(new, lambda x: F.struct(F.substring_index(x, "=", 1).alias("property"), F.regexp_replace(x, "(?s)^[^=]*=", "").alias("text")))
            return F.when(F.size(new) > 0, F.concat(F.coalesce(F.col(f), F.array().cast(kinds[f])), new.cast(kinds[f]))).otherwise(F.col(f)).alias(f)
        if kinds[f].typeName() == "map":  # of an element's attributes plans write its text
            kept = F.map_filter(F.coalesce(F.col(f), F.create_map().cast(kinds[f])), lambda k, _: k != "alt")
            return F.when(F.col(f"new_{f}").isNull(), F.col(f)).otherwise(F.map_concat(kept, F.create_map(F.lit("alt"), F.col(f"new_{f}")))).alias(f)
        return F.coalesce(F.col(f"new_{f}").cast(kinds[f]), F.col(f)).alias(f)

    return both.select(*(now(c) for c in table.columns))


def apply_plan(spark: SparkSession, tables: dict[str, DataFrame], plan: DataFrame, files: int | None = None) -> dict[str, DataFrame]:
    """All fact tables after the plan's writes; tables that it does not touch are passed on as they are.

    With ``files`` the writes lie by documents, in as many files as the tables do.
    """
    changes = patches(spark, plan)
    changes = _stored(changes.repartition(files, "doc_id") if files else changes, "patches", files)
    return tables | {name: patched(tables[name] if name in tables else spark.createDataFrame([], SCHEMAS[name]), name, changes, files) for name in KEYS if name in tables}


def _stored(df: DataFrame, name: str, files: int | None) -> DataFrame:
    with by_documents(df.sparkSession):
        return df.sparkSession.table(table_by(df, name, files)) if files else stored(df, name)


def _touched(rule: rules.Rule) -> bool:
    """Whether the rule reads a table that repairs write."""
    return not rules.reads(rule).isdisjoint(KEYS)


def scanned(spark: SparkSession, tables: dict[str, DataFrame], scanners: tuple[str, ...], name: str, before: DataFrame | None = None) -> DataFrame:
    """Findings, each scanner's planned and stored by itself, so that no plan grows with the number of scanners.

    What rules that read no repaired table found ``before`` stands: their tables are the same, so are their findings.
    """
    parts = []
    for s in scanners:
        same = () if before is None else tuple(r.id for r in rules.REGISTRY[s] if not _touched(r))
        if len(same) < len(rules.REGISTRY[s]):
            with by_documents(spark):
                parts.append(stored(rules.findings(spark, tables, (s,), disabled=same), f"{name}-{s}"))
        if same:
            parts.append(before.filter((F.col("scanner") == s) & F.col("rule").isin(*same)))
    return reduce(DataFrame.unionByName, parts)


def run(spark: SparkSession, tables: dict[str, DataFrame], scanners: tuple[str, ...], tools: tuple[str, ...] | None = None, wanted: DataFrame | None = None, before: DataFrame | None = None, files: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(findings before, plan, findings after): scan, plan, patch, rescan; each of them stored, scanners one or more.

    ``wanted`` (doc, rule) keeps only these of the plan, such as ``analytics.fixable`` gives up to a tier.
    ``before`` may hand in the first scan of these tables. Where they lie by documents in ``files`` files, patched ones do too.
    """
    before = before if before is not None else scanned(spark, tables, scanners, "before")
    plan = fixes.planned(spark, tables, tools)
    if wanted is not None:
        plan = plan.join(wanted.select("doc", "rule").distinct(), ["doc", "rule"], "left_semi").select(plan.columns)
    with by_documents(spark):
        plan = stored(plan, "plan")
    read = rules.needed(scanners)
    changed = apply_plan(spark, {name: df for name, df in tables.items() if name in read}, plan, files)
    changed = {name: _stored(df, f"patched-{name}", files) if name in KEYS else df for name, df in changed.items()}
    return before, plan, scanned(spark, changed, scanners, "after", before)


def remediation(documents: DataFrame, before: DataFrame, plan: DataFrame, after: DataFrame) -> DataFrame:
    """Per document: writes made and left to a person, and score, grade, errors and warnings before and after.

    ``documents`` has doc and access_ok; a document that could not be read scores 0 both times.
    """
    done = plan.groupBy("doc").agg(F.count_if(F.col("status") == "fixed").alias("fixed"), F.count_if(F.col("status") != "fixed").alias("needs_human"))

    def scored(findings: DataFrame, when: str) -> DataFrame:
        rows = scoring.with_clean_documents(documents.select("doc", "access_ok"), scoring.score_documents(findings))
        return rows.select("doc", *(F.col(c).alias(f"{c}_{when}") for c in ("score", "grade", "errors", "warnings")))

    out = scored(before, "before").join(scored(after, "after"), "doc").join(done, "doc", "left").na.fill(0, ["fixed", "needs_human"])
    return out.withColumn("delta", F.col("score_after") - F.col("score_before"))
