"""Queries over the driver's tables: each shows one operator on a projection that carries its signal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from lectern.functions import alt_text
from lectern.functions.text import contrast_ratio, pdf_date, split_lines, strip
from lectern.operators import analytics, audits, export, fix_loop, history, images, incremental, markdown, repair, reports, scoring, tree
from lectern import facts
from lectern.plans import dims, fixes, rules
from lectern.sources import single_file
from lectern.sources.files import mapped_clauses, page_elements
from lectern.storage import by_documents, new_path, small, stored
from lectern.streaming import scan

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def found(spark: SparkSession, sf: str, *also: Column) -> DataFrame:
    """Line items as findings: an order is a document, a part's number the rule, the return flag the severity; ``also`` adds columns."""
    li = table(spark, sf, "lineitem")
    types = F.array(*(F.lit(t) for t in dims.TYPES))
    level = F.when(F.col("l_returnflag") == "R", "Error").when(F.col("l_returnflag") == "A", "Warning").otherwise("Info")
    sure = F.element_at(F.array(F.lit("High"), F.lit("Medium"), F.lit("Low")), (F.col("l_linenumber") % 3 + 1).cast("int"))
    return li.select(F.col("l_orderkey").alias("doc"), F.element_at(types, (F.col("l_orderkey") % 6 + 1).cast("int")).alias("type"), F.concat(F.lit("R"), F.col("l_partkey") % 12).alias("rule"), level.alias("severity"), sure.alias("confidence"), F.col("l_linenumber").cast("string").alias("message"), F.col("l_linenumber").cast("int").alias("page"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ord"), "l_shipdate", *also)


def rules_of(spark: SparkSession) -> DataFrame:
    return spark.range(14).select(F.concat(F.lit("R"), "id").alias("rule"), F.concat(F.lit("1."), F.col("id") % 5).alias("criterion"))


def tiers_of(spark: SparkSession) -> DataFrame:
    tools = F.array(*(F.lit(t) for t in dims.TYPE_TOOLS.values()))
    rule = F.concat(F.lit("R"), "id")
    return spark.range(9).select(rule.alias("rule"), (F.col("id") % 3 + 1).cast("int").alias("tier"), F.element_at(tools, (F.col("id") % 5 + 1).cast("int")).alias("tool"), F.when(F.col("id") == 3, "X3").otherwise(rule).alias("fixer_rule"))


def tools_of(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(dims.TYPE_TOOLS.items()), "type string, tool string")


for _profile in ("tools", "core", "confidence"):
    QUERIES[f"score_{_profile}"] = lambda spark, sf, p=_profile: scoring.score_documents(found(spark, sf), p)


@query
def score_markdown(spark, sf):
    level = F.element_at(F.array(*(F.lit(x) for x in scoring.MARKDOWN)), (F.col("page") % 4 + 1).cast("int"))
    return scoring.score_documents(found(spark, sf).withColumn("severity", level), "markdown").select("doc", "score", "grade")


@query
def score_all_documents(spark, sf):
    docs = table(spark, sf, "orders").select(F.col("o_orderkey").alias("doc"), (F.col("o_orderkey") % 50 != 0).alias("access_ok"))
    return scoring.with_clean_documents(docs, scoring.score_documents(found(spark, sf))).select("doc", "access_ok", "errors", "warnings", "score", "grade")


@query
def corpus_score(spark, sf):
    return scoring.corpus_score(scoring.score_documents(found(spark, sf)))


@query
def projected_score(spark, sf):
    s = scoring.score_documents(found(spark, sf))
    return s.select("doc", scoring.projected_score(*(F.col(c) for c in ("score", "errors", "warnings", "infos"))).alias("projected"))


@query
def grade_histogram(spark, sf):
    return scoring.score_documents(found(spark, sf)).groupBy("grade").agg(F.count("*").alias("files"))


def _with_others(spark, sf):
    """Findings of which some have a severity of another name, or none."""
    level = F.when(F.col("page") == 4, "Critical").when(F.col("page") != 5, F.col("severity"))
    return found(spark, sf).withColumn("severity", level)


@query
def severity_pivot(spark, sf):
    return analytics.severity_pivot(_with_others(spark, sf), "doc")


@query
def severity_by_type(spark, sf):
    return analytics.severity_pivot(_with_others(spark, sf), "type")


@query
def audit_grouping_sets(spark, sf):
    return analytics.audit_totals(found(spark, sf))


@query
def audit_rollup(spark, sf):
    return analytics.rollup_totals(found(spark, sf))


@query
def dedup_rule_message(spark, sf):
    rows = found(spark, sf).withColumn("message", (F.col("page") % 2).cast("string"))
    return analytics.deduplicated(rows).select("doc", "rule", "message", "ord")


@query
def findings_by_rule(spark, sf):
    return analytics.by_rule(found(spark, sf))


@query
def affected_files(spark, sf):
    return found(spark, sf).groupBy("type").agg(F.count_distinct("doc").alias("files"))


@query
def summary_table(spark, sf):
    return analytics.summary_table(found(spark, sf), rules_of(spark))


@query
def priority_plan(spark, sf):
    return analytics.priority_plan(found(spark, sf))


@query
def executive_top6(spark, sf):
    return analytics.executive(found(spark, sf))


@query
def consolidate_pages(spark, sf):
    """Line items of one number in an order have equal ``ord``: the first is the one that the table has first."""
    place = (F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    return analytics.consolidated(found(spark, sf, *place), "file", "row")


@query
def filter_search_panel(spark, sf):
    return analytics.search(rule_findings(spark, sf), "Warning", "1.3.1").select("doc", "rule", "ord", "message", "sort_key")


def _halves(spark, sf):
    f = found(spark, sf)
    cut = F.lit("1995-06-01").cast("timestamp")
    return f.filter(F.col("l_shipdate") < cut), f.filter(F.col("l_shipdate") >= cut)


@query
def verify_fix_delta(spark, sf):
    return analytics.verify_fix(*_halves(spark, sf))


@query
def baseline_status(spark, sf):
    before, after = _halves(spark, sf)
    known = F.when(F.col("page") <= 3, F.col("rule")).otherwise(F.concat(F.lit("X"), "rule"))
    return analytics.baseline_status(before.withColumn("rule", known), after, before)


@query
def score_delta(spark, sf):
    before, after = (scoring.score_documents(h).select("doc", F.col("score").alias(n)) for h, n in zip(_halves(spark, sf), ("before", "after")))
    return analytics.remediation_means(before.join(after, "doc"))


@query
def merge_reaggregate(spark, sf):
    f = found(spark, sf)
    return scoring.corpus_score(scoring.score_documents(analytics.merged(*(f.filter(F.col("doc") % 3 == k) for k in range(3)))))


@query
def fixable_rules(spark, sf):
    return analytics.fixable(found(spark, sf), tiers_of(spark), 2, tools_of(spark)).select("doc", F.array_join("rules", ",").alias("rules"))


@query
def best_tier(spark, sf):
    return analytics.best_tier(found(spark, sf), tiers_of(spark))


@query
def rules_by_tier(spark, sf):
    return found(spark, sf).join(small(tiers_of(spark)), "rule").groupBy("tier").agg(F.count_distinct("rule").alias("rules"), F.count("*").alias("findings"))


@query
def roi_priority(spark, sf):
    return analytics.roi(found(spark, sf))


@query
def pattern_classification(spark, sf):
    f = found(spark, sf)
    return analytics.patterns(f, f.agg(F.count_distinct("doc")).first()[0], wide=0.3)


@query
def template_fingerprint(spark, sf):
    return analytics.templates(found(spark, sf))


@query
def vpat_conformance(spark, sf):
    f = found(spark, sf)
    return analytics.conformance(f.withColumn("rule", F.when(F.col("rule") == "R4", "R99").otherwise(F.col("rule"))), rules_of(spark), f.agg(F.count_distinct("doc")).first()[0])


@query
def metadata_dashboard(spark, sf):
    p = table(spark, sf, "part")
    return p.groupBy("p_brand").agg(F.count("*").alias("files"), F.count_distinct("p_type").alias("authors"), F.count_if(F.col("p_size") > 25).alias("titled"), F.min_by("p_partkey", F.struct("p_retailprice", "p_partkey")).alias("smallest"), F.max("p_retailprice").alias("largest"))


@query
def quick_fix_groups(spark, sf):
    groups = spark.createDataFrame([(1, "tagging", "R1"), (1, "tagging", "R2"), (2, "title", "R99"), (3, "language", "R5"), (4, "forms", "R7")], "position int, title string, rule string")
    return analytics.quick_fixes(found(spark, sf), groups)


@query
def stratified_sample(spark, sf):
    docs = found(spark, sf).select("doc", "type").distinct()
    return analytics.stratified_sample(docs, "type", F.struct(F.md5(F.col("doc").cast("string")), "doc"), 60)


def _headings(spark, sf):
    return table(spark, sf, "part").select(F.col("p_brand").alias("doc"), (F.col("p_size") % 6 + 1).cast("int").alias("level"), F.col("p_partkey").alias("ord"))


@query
def heading_skip_lag(spark, sf):
    return tree.heading_skips(_headings(spark, sf), "doc", "level", "ord")


@query
def heading_holes(spark, sf):
    """Headings of small documents in which level 2 never occurs."""
    h = _headings(spark, sf)
    small = h.withColumn("doc", F.concat("doc", F.lit("/"), F.col("ord") % 50)).withColumn("level", F.when(F.col("level") == 2, 4).otherwise(F.col("level")))
    return tree.heading_holes(small, "doc", "level")


@query
def docx_seen_levels(spark, sf):
    return tree.unseen_levels(_headings(spark, sf), "doc", "level", "ord")


@query
def multiple_h1(spark, sf):
    nth = F.row_number().over(Window.partitionBy("doc").orderBy("ord"))
    return _headings(spark, sf).filter("level = 1").withColumn("nth", nth).filter("nth > 1").select("doc", "ord", "nth")


@query
def heading_repair_fold(spark, sf):
    got = repair.heading_repairs(_headings(spark, sf), "doc", "ord", "level")
    return got.select("doc", F.array_join("repaired", ",").alias("repaired"))


@query
def list_continuation(spark, sf):
    w = Window.partitionBy("doc").orderBy("ord")
    rows = _headings(spark, sf).withColumn("items", (F.col("ord") % 9).cast("int"))
    return rows.withColumn("next_level", F.lead("level").over(w)).withColumn("next_items", F.lead("items").over(w)).filter("level = next_level and (items <= 5 or next_items <= 5)").select("doc", "ord", "items", "next_items")


def _markdown(spark, sf):
    """Parts as a small Markdown text each."""
    p = table(spark, sf, "part")
    links = F.array(*(F.lit(x) for x in ("here", "read more about us", "https://x.org/a", "Annual report", "click here", "the zip file", "")))
    alts = F.array(*(F.lit(x) for x in ("", "image", "photo.jpg", "A chart of sales")))
    pick = lambda a, n, m: F.element_at(a, (F.col("p_partkey") % n + 1).cast("int")) if m == 0 else F.element_at(a, (F.col("p_size") % n + 1).cast("int"))
    text = F.concat(
        F.when(F.col("p_partkey") % 3 == 0, F.lit("# ")).otherwise(F.lit("## ")), "p_name", F.lit("\n\n"),
        F.when(F.col("p_partkey") % 2 == 0, "Some words.\n").otherwise(""),
        F.lit("See ["), pick(links, 7, 0), F.lit("](files/a"), F.when(F.col("p_size") % 2 == 0, ".pdf").otherwise(".zip"), F.lit(") and ![") , pick(alts, 4, 1), F.lit("](a.png)\n```\n[here](b.pdf)\n# no\n```\n"),
        F.when(F.col("p_size") % 3 == 0, "#### Deep\n").otherwise(""), F.lit("| a | | c |\n|---|---|---|\n| 1 | 2 | 3 |\n"),
        F.when(F.col("p_size") % 5 == 0, "# More 😀😀\ntext ☀ here\n").otherwise(""), F.when(F.col("p_size") % 7 == 0, "+----+----+----+\n").otherwise(""), F.when(F.col("p_size") % 11 == 0, "## D\n\n```mermaid\ngraph\n```\n").otherwise(""))
    return p.select(F.col("p_partkey").alias("doc_id"), text.alias("text"))


@query
def md_lines(spark, sf):
    return markdown.line_states(_markdown(spark, sf)).select("doc_id", "line_no", "raw", "outside", "opens", "previous")


@query
def md_links(spark, sf):
    return markdown.links(markdown.line_states(_markdown(spark, sf))).select("doc_id", "line_no", "text", "kind", "hides_type")


@query
def md_alt_quality(spark, sf):
    got = markdown.images(markdown.line_states(_markdown(spark, sf)))
    kind = F.when(F.col("alt") == "", "missing").when(F.lower("alt").isin(*dims.GENERIC_ALT) | F.col("alt").rlike(r"^[\w-]+\.\w{2,4}$"), "weak")
    return got.select("doc_id", "line_no", "alt", kind.alias("kind")).filter("kind is not null")


@query
def md_headings(spark, sf):
    return markdown.headings(markdown.line_states(_markdown(spark, sf)))


@query
def md_tables(spark, sf):
    got = markdown.tables(markdown.line_states(_markdown(spark, sf)))
    return got.select("doc_id", "line_no", (F.col("previous").isNull() | F.col("previous").startswith("#")).alias("no_description"), F.posexplode("cells").alias("place", "cell")).filter("cell = '' or no_description").select("doc_id", "line_no", "no_description", "place", "cell")


@query
def md_emoji(spark, sf):
    return markdown.emoji(markdown.line_states(_markdown(spark, sf))).select("doc_id", "line_no", "in_heading", F.length("run").alias("n"))


@query
def md_fences(spark, sf):
    return markdown.line_states(_markdown(spark, sf)).filter("opens").select("doc_id", "line_no", "language", "previous")


@query
def underscore_fill(spark, sf):
    p = table(spark, sf, "part").select(F.col("p_partkey").cast("string").alias("path"), F.concat(F.lit("Name "), F.repeat(F.lit("_"), F.col("p_size").cast("int")), F.lit("\n  \n"), F.repeat(F.lit("_"), (F.col("p_size") % 20).cast("int")), F.lit(" x\n"), "p_name").alias("text"))
    return scan.fill_lines(p).filter("fill_lines > 0")


@query
def text_extractable(spark, sf):
    d = table(spark, sf, "documents").select((F.col("doc_id") / 10).cast("long").alias("book"), F.col("doc_id").alias("page"), (F.length(strip(F.coalesce("text", F.lit("")))) < 40).alias("poor"))
    got = d.groupBy("book").agg(F.count("*").alias("pages"), F.count_if("poor").alias("bad"), F.array_join(F.slice(F.array_sort(F.collect_list(F.when(F.col("poor"), F.col("page")))), 1, 10), ",").alias("listed"))
    return got.filter("bad > 0").withColumn("severity", F.when(F.col("bad") == F.col("pages"), "error").otherwise("warning"))


@query
def paragraph_150_words(spark, sf):
    lines = table(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "line"))
    return lines.select("doc_id", "i", F.regexp_count("line", F.lit("[^ ]+")).alias("words")).filter("words > 150")


def _alts(spark, sf):
    p = table(spark, sf, "part")
    forms = F.element_at(F.array(F.col("p_name"), F.concat(F.lit("image of "), "p_name"), F.concat("p_name", F.lit(".png")), F.lit("photo"), F.lit(""), F.concat(F.lit("A bar chart showing the percent increase of "), "p_name"), F.concat(F.lit("["), "p_type", F.lit("]")), F.repeat(F.concat("p_name", F.lit(" ")), 9)), (F.col("p_partkey") % 8 + 1).cast("int"))
    return p.select("p_partkey", "p_brand", "p_type", forms.alias("text"))


@query
def alt_score(spark, sf):
    got = _alts(spark, sf).withColumn("flags", alt_text.flags(F.col("text"), F.concat(F.lit("About "), F.col("p_type"), F.lit(" PHOTO"))))
    return got.select("p_partkey", alt_text.score(F.col("flags")).alias("score"), F.array_join(F.transform("flags", lambda f: f["code"]), ",").alias("codes"))


@query
def alt_rank(spark, sf):
    return alt_text.rank(_alts(spark, sf), ["p_brand"], "p_partkey").select("p_brand", "p_partkey", "score", "rank")


@query
def alt_recommendation(spark, sf):
    a = alt_text.rank(_alts(spark, sf), ["p_brand", "p_type"], "p_partkey")
    best = a.filter("rank = 1").select("p_brand", "p_type", F.when(F.col("p_partkey") % 4 != 0, F.col("score")).alias("best"))
    have = a.groupBy("p_brand", "p_type").agg(F.max(F.when(F.col("p_partkey") % 3 == 0, F.col("score"))).alias("existing"))
    return best.join(have, ["p_brand", "p_type"], "full_outer").withColumn("advice", alt_text.advice(F.col("existing"), F.col("best")))


def _tree(spark, sf):
    """Region > nation > customer > order as elements of one tree per region."""
    n = table(spark, sf, "nation").withColumnRenamed("n_regionkey", "doc_id")
    c = table(spark, sf, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    o = table(spark, sf, "orders").join(c, F.col("o_custkey") == F.col("c_custkey"))
    none = F.array().cast("array<int>")
    level = lambda df, node, parent, ord_, tag, own: df.select(F.col("doc_id").cast("long"), node.cast("int").alias("node_id"), parent.cast("int").alias("parent_id"), ord_.cast("int").alias("ord"), tag.alias("tag"), own.alias("mcids"))
    r = table(spark, sf, "region").withColumn("doc_id", F.col("r_regionkey"))
    key = F.col("n_nationkey")
    parts = [
        level(r, F.lit(0), F.lit(None), F.lit(0), F.lit("Document"), none),
        level(n, key + 1, F.lit(0), key, F.lit("Sect"), none),
        level(c, F.col("c_custkey") + 1000, key + 1, F.col("c_custkey"), F.when(F.col("c_custkey") % 5 == 0, "Figure").when(F.col("c_custkey") % 5 == 1, "Caption").otherwise("Sect"), none),
        level(o, F.col("o_orderkey") + 1_000_000, F.col("c_custkey") + 1000, F.col("o_orderkey"), F.when(F.col("o_orderkey") % 3 == 0, "Form").otherwise("P"), F.array((F.col("o_orderkey") % 1000).cast("int"))),
    ]
    nodes = parts[0]
    for p in parts[1:]:
        nodes = nodes.unionByName(p)
    return nodes.withColumn("has_objr", F.lit(False)).withColumn("page", (F.col("node_id") % 7).cast("int"))


@query
def tree_preorder(spark, sf):
    return tree.labelled(_tree(spark, sf)).select("doc_id", "node_id", "depth", "preorder", "post")


@query
def sect_depth(spark, sf):
    return tree.nesting(tree.labelled(_tree(spark, sf)).filter("tag = 'Sect'"))


@query
def leaf_sequence(spark, sf):
    return tree.leaves(tree.labelled(_tree(spark, sf))).select("doc_id", "node_id", "kind", "place")


@query
def forms_detached(spark, sf):
    got = tree.leaves(tree.labelled(_tree(spark, sf))).groupBy("doc_id").agg(F.count_if(F.col("kind") == "form").alias("forms"), F.count_if(F.col("kind") == "text").alias("texts"), F.min(F.when(F.col("kind") == "form", F.col("place"))).alias("first"), F.max(F.when(F.col("kind") == "form", F.col("place"))).alias("last"))
    block = F.col("last") - F.col("first") + 1
    return got.withColumn("detached", (F.col("forms") >= 2) & (F.col("texts") > 0) & (2 * F.col("first") > F.col("texts")) & (10 * (block - F.col("forms")) < block))


@query
def figure_caption_pair(spark, sf):
    after = F.lead("tag").over(Window.partitionBy("doc_id", "parent_id").orderBy("ord"))
    return _tree(spark, sf).withColumn("after", after).filter("tag = 'Figure' and after <> 'Caption'").select("doc_id", "node_id", "after")


@query
def tag_counts(spark, sf):
    return _tree(spark, sf).groupBy("doc_id", "tag").agg(F.count("*").alias("n"))


@query
def reading_order_by_page(spark, sf):
    return _tree(spark, sf).filter("size(mcids) > 0").groupBy("doc_id", "page").agg(F.count("*").alias("n"), F.sum(F.size("mcids")).alias("contents"))


@query
def parent_tree(spark, sf):
    return tree.parent_tree(tree.labelled(_tree(spark, sf)))


@query
def inversion_rate(spark, sf):
    li = table(spark, sf, "lineitem")
    place = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_extendedprice", "l_linenumber"))
    rows = li.select(F.col("l_orderkey").alias("doc_id"), F.lit(1).alias("page"), F.col("l_linenumber").cast("int").alias("mcid"), place.cast("int").alias("pos"))
    got = tree.inversion_rates(rows.withColumn("pos", F.col("mcid")), rows)
    return got.select("doc_id", F.col("paint_n").alias("n"), F.round("rate", 9).alias("rate"))


@query
def empty_runs(spark, sf):
    e = table(spark, sf, "events").withColumn("ord", F.struct("ts", "event_id"))
    return tree.runs(e, "user_id", "ord", F.col("event_type") == "error", 2)


def _fields(spark, sf):
    o = table(spark, sf, "orders")
    return o.select(F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("ord"), F.col("o_orderpriority").alias("name"), (F.when(F.col("o_orderstatus") == "F", 32768).otherwise(0) + F.when(F.col("o_orderkey") % 2 == 0, 2).otherwise(0)).cast("int").alias("ff"), F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("Required "), F.col("o_orderstatus"))).when(F.col("o_orderkey") % 3 == 1, F.col("o_orderpriority")).alias("tooltip"))


@query
def duplicate_field_names(spark, sf):
    return _fields(spark, sf).filter("ff & 32768 = 0").groupBy("doc_id", "name").agg(F.count("*").alias("n")).filter("n > 1")


@query
def radio_consistency(spark, sf):
    return _fields(spark, sf).filter("ff & 32768 <> 0 and tooltip is not null").groupBy("doc_id", F.element_at(F.split("name", "-"), -1).alias("grp")).agg(F.count_distinct("tooltip").alias("tooltips")).filter("tooltips > 1")


@query
def required_label(spark, sf):
    return _fields(spark, sf).filter("ff & 2 <> 0 and tooltip is not null and not contains(lower(tooltip), 'required')").groupBy("doc_id").agg(F.count("*").alias("n"))


@query
def orphan_widgets(spark, sf):
    c = table(spark, sf, "customer")
    return c.join(table(spark, sf, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey", "c_name")


@query
def lang_valid(spark, sf):
    from lectern.plans.rules import LANG

    codes = F.element_at(F.array(*(F.lit(x) for x in ("en", "en-US", "es-419", "en419", "zh-Hant-TW", "en_US", "de-1996", "x"))), (F.col("p_partkey") % 8 + 1).cast("int"))
    return table(spark, sf, "part").select("p_partkey", codes.alias("lang")).filter(~F.col("lang").rlike(LANG))


@query
def page_structure(spark, sf):
    """Of each web page: elements, title, first-level headings, links and images without a text."""
    el = page_elements(table(spark, sf, "pages"))
    is_ = lambda tag: F.col("el") == tag
    return el.groupBy(F.col("doc_id").alias("page_id")).agg(F.count_if(is_("title")).alias("titles"), F.count_if(is_("h1")).alias("h1"), F.count_if(is_("a")).alias("links"), F.count_if(is_("img") & F.col("attrs")["alt"].isNull()).alias("bare_images"))


@query
def page_lang(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.regexp_extract("html", '<html lang="([^"]*)"', 1).alias("lang"))


@query
def page_link_text(spark, sf):
    links = table(spark, sf, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit(r"<a [^>]*>([^<]*)</a>"), F.lit(1))).alias("text"))
    return links.filter(F.length("text") <= 3).groupBy("page_id").agg(F.count("*").alias("n"))


@query
def dup_slide_titles(spark, sf):
    return table(spark, sf, "part").groupBy("p_brand", F.lower("p_type").alias("title")).agg(F.count("*").alias("n")).filter("n > 1")


@query
def autonumber_titles(spark, sf):
    return repair.numbered_titles(table(spark, sf, "part"), "p_brand", "p_partkey", "p_type").select("p_partkey", "new_title")


@query
def contrast_ratios(spark, sf):
    k = F.col("p_partkey")
    return table(spark, sf, "part").select("p_partkey", F.round(contrast_ratio([k % 256, k * 7 % 256, k * 13 % 256], [k * 3 % 256, k * 5 % 256, k * 11 % 256]), 6).alias("ratio"))


@query
def windowed_event_findings(spark, sf):
    return scan.windowed(table(spark, sf, "events"), "1 hour")


@query
def sliding_event_findings(spark, sf):
    return scan.windowed(table(spark, sf, "events"), "2 hours", "1 hour")


@query
def session_event_findings(spark, sf):
    return scan.sessions(table(spark, sf, "events"), "30 minutes")


@query
def final_assessment(spark, sf):
    return reports.assessment(scoring.corpus_score(scoring.score_documents(found(spark, sf))))


@query
def scan_profile(spark, sf):
    return reports.profile(found(spark, sf), "moderate").groupBy("severity").agg(F.count("*").alias("n"))


@query
def strengths(spark, sf):
    f = found(spark, sf)
    rows = [(1, "tagged", "R1", "pdf"), (1, "tagged", "R99", "pdf"), (2, "labels", "R98", "pdf"), (3, "images", "R97", None), (3, "images", "R96", None), (4, "titles", "R2", None), (5, "odd", "R95", "odt")]
    return reports.strengths(f.select("doc", "type"), f, spark.createDataFrame(rows, "position int, title string, rule string, type string"))


@query
def time_estimates(spark, sf):
    f = found(spark, sf)
    rows = [("language", "R1", True, 2, 2, True), ("language", "R2", True, 2, 2, True), ("titles", "R3", True, 3, 3, True), ("titles", "R4", False, 3, 3, True), ("labels", "R5", True, 10, 20, False), ("slides", "R99", True, 5, 10, False), ("slides", "R6", False, 5, 10, False)]
    tasks = spark.createDataFrame(rows, "task string, rule string, shows boolean, least int, most int, each boolean")
    return reports.time_estimates(table(spark, sf, "orders"), f, tasks)


@query
def scorecard(spark, sf):
    return reports.scorecard(scoring.score_documents(found(spark, sf))).withColumn("mean", F.round("mean", 6))


@query
def type_ranking(spark, sf):
    scored = scoring.score_documents(found(spark, sf))
    types = F.element_at(F.array(*(F.lit(t) for t in dims.TYPES)), (F.col("doc") % 6 + 1).cast("int"))
    return reports.ranking(scored.withColumn("type", types), "type").withColumn("mean_errors", F.round("mean_errors", 6))


@query
def file_totals(spark, sf):
    return reports.file_totals(scoring.score_documents(found(spark, sf)))


@query
def form_summary(spark, sf):
    kinds = F.element_at(F.array(F.lit("Tx"), F.lit("Btn"), F.lit(None)), (F.col("ord") % 3 + 1).cast("int"))
    names = F.when(F.col("ord") % 5 == 0, "  ").otherwise(F.col("name"))
    return reports.form_summary(_fields(spark, sf).withColumn("ft", kinds).withColumn("name", names))


@query
def tag_inventory(spark, sf):
    k = F.col("node_id") % 4
    tags = F.when(k == 0, "InlineShape").when(k == 1, "Textbox").otherwise(F.col("tag"))
    nodes = _tree(spark, sf).withColumn("tag", tags).withColumn("alt", F.when(F.col("node_id") % 3 == 0, "x")).withColumn("actual_text", F.lit(" ")).withColumn("preorder", F.col("node_id"))
    roles = table(spark, sf, "region").select(F.col("r_regionkey").cast("long").alias("doc_id"), F.lit("Textbox").alias("tag"), F.lit("Sect").alias("maps_to")).filter("doc_id <> 2")
    return reports.tag_inventory(nodes, roles)


@query
def key_problems(spark, sf):
    problems = (("R1", "error", "no title"), ("R3", "warning", "{n} elements without text"), ("R5", "error", "{n} fields"))
    return reports.key_problems(found(spark, sf), problems)


@query
def file_inventory(spark, sf):
    files = table(spark, sf, "documents").select("source", F.when(F.col("doc_id") % 7 == 0, " ").when(F.col("doc_id") % 11 != 0, "t").alias("title"), F.when(F.col("doc_id") % 5 != 0, F.col("lang")).alias("lang"))
    return reports.inventory(files, "source")


@query
def md_repeated_links(spark, sf):
    """Parts of one size as the link lines of a document."""
    p = table(spark, sf, "part")
    line = F.concat(F.lit("["), "p_type", F.lit("](u"), F.col("p_partkey") % 7, F.lit(")"))
    texts = p.groupBy(F.col("p_size").cast("long").alias("doc_id")).agg(F.array_join(F.array_sort(F.collect_list(line)), "\n").alias("text"))
    return markdown.repeated_link_texts(markdown.line_states(texts))


@query
def md_anchors(spark, sf):
    k = F.col("p_partkey")
    text = F.concat(F.lit("# Big Plan, now!\n## Big plan now\n[a](#big-plan-now"), F.when(k % 3 == 0, "-1").when(k % 3 == 1, "-2").otherwise(""), F.lit(")\n[b](#"), F.when(k % 2 == 0, "Big-Plan-Now").otherwise("gone"), F.lit(")\n"))
    return markdown.broken_anchors(markdown.line_states(table(spark, sf, "part").select(k.alias("doc_id"), text.alias("text"))))


@query
def page_missing_alt(spark, sf):
    """Images without a text, in pages that were given one with and one without."""
    html = F.concat("html", F.when(F.col("page_id") % 2 == 0, '<img src="a.png">').otherwise('<img src="a.png" alt="A chart">'))
    el = page_elements(table(spark, sf, "pages").withColumn("html", html))
    return el.filter((F.col("el") == "img") & F.col("attrs")["alt"].isNull()).groupBy(F.col("doc_id").alias("page_id")).agg(F.count("*").alias("n"))


@query
def pdf_dates(spark, sf):
    raw = F.element_at(F.array(*(F.lit(x) for x in ("D:20260209143005Z", "D:20260209", "D:2026020914", "9 Feb 2026", ""))), (F.col("p_partkey") % 5 + 1).cast("int"))
    return table(spark, sf, "part").select("p_partkey", pdf_date(raw).alias("shown"))


@query
def image_texts(spark, sf):
    """Line items as images of a supplier's document, orders as the texts found for them."""
    w = Window.partitionBy("l_suppkey", "l_linenumber").orderBy("l_orderkey", "l_partkey", "l_extendedprice")
    li = table(spark, sf, "lineitem")
    found_images = li.select(F.col("l_suppkey").alias("doc_id"), F.col("l_linenumber").cast("int").alias("page"), (F.row_number().over(w) - 1).alias("idx"), (F.col("l_partkey") % 200).alias("width"), F.lit(60).alias("height"), F.concat(F.when(F.col("l_partkey") % 2 == 0, F.unhex(F.lit("FFD8"))).otherwise(F.unhex(F.lit("47494638"))), (F.col("l_partkey") % 40).cast("string").cast("binary")).alias("content"))
    key = F.col("o_orderkey")
    texts = table(spark, sf, "orders").select((key % 20 + 1).alias("doc_id"), F.when(key % 3 != 0, key % 7 + 1).cast("int").alias("page"), key.alias("ord"), F.concat(F.lit("a"), key).alias("alt"))
    return images.with_existing(images.to_describe(found_images), texts).select("doc_id", "page", "idx", images.mime(F.col("content")).alias("mime"), "existing_alt")


@query
def alt_answers(spark, sf):
    page = F.concat(F.lit('<figure><img src="x" alt=" A &amp; '), "p_name", F.lit('"><figcaption>Long <b>text</b></figcaption></figure>'))
    answers = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("```html\n"), page, F.lit("\n```"))).when(F.col("p_partkey") % 3 == 1, page).otherwise(F.lit("<p>no image</p>"))
    return table(spark, sf, "part").select("p_partkey", alt_text.parsed(answers).alias("got")).select("p_partkey", "got.alt", "got.description", "got.ok")


_found: dict[tuple[str, str, str], DataFrame] = {}


def rule_findings(spark: SparkSession, sf: str, *scanners: str) -> DataFrame:
    """Findings of the registered rules over the fact tables; each scanner's are stored once per application."""
    parts = []
    for scanner in scanners or rules.REGISTRY:
        key = (spark.sparkContext.applicationId, sf, scanner)
        if key not in _found:
            tables = facts.tables(spark, sf, rules.needed((scanner,)))
            with by_documents(spark):
                _found[key] = stored(rules.findings(spark, tables, (scanner,)), f"findings-{scanner}")
        parts.append(_found[key])
    return analytics.merged(*parts)


for _scanner in rules.REGISTRY:
    QUERIES[f"findings_{_scanner}"] = lambda spark, sf, s=_scanner: rule_findings(spark, sf, s)


@query
def findings_scores(spark, sf):
    return scoring.score_families(rule_findings(spark, sf), _documents(spark, sf))


@query
def findings_deduplicated(spark, sf):
    return analytics.deduplicated(rule_findings(spark, sf)).select("doc", "rule", "message", "ord")


@query
def findings_summary(spark, sf):
    return analytics.summary_table(rule_findings(spark, sf), dims.rule_dim(spark)).select("rule", "level", "files", "findings")


@query
def findings_by_page(spark, sf):
    return analytics.by_page(rule_findings(spark, sf))


def _snapshots(spark, sf):
    """The documents as files at two times: some came, some went, some have another text, some only another time."""
    key = F.col("doc_id")
    path = F.concat(F.lit("in/"), F.coalesce("source", F.lit("none")), F.lit("/"), key.cast("string"), F.when(key % 3 == 0, ".md").otherwise(".txt"))
    files = table(spark, sf, "documents").select(key, path.alias("path"), F.when(key % 3 == 0, "md").otherwise("txt").alias("type"), F.length("text").cast("long").alias("size_bytes"), F.col("text").alias("content"))
    day = lambda n: F.timestamp_seconds(F.lit(86400) * n)
    before = files.filter(key % 17 != 3).withColumn("modified", day(key % 90)).drop("doc_id")
    after = files.filter(key % 19 != 5).withColumn("content", F.when(key % 7 == 0, F.concat(F.coalesce("content", F.lit("")), F.lit("\nSame line\nSame line"))).otherwise(F.col("content")))
    return before, after.withColumn("modified", day(F.when(key % 7 < 2, 100).otherwise(key % 90))).drop("doc_id")


def _repeated_lines(files):
    """Findings of lines that a file has more than once, and of files without any text."""
    lines = files.select("path", F.explode(F.split("content", "\n")).alias("element")).filter("element <> ''").groupBy("path", "element").agg(F.count("*").alias("n"))
    empty = files.filter("content is null or content = ''").select("path", F.lit("TEXT.MISSING").alias("rule"), F.lit(None).cast("string").alias("element"), F.lit(1).cast("long").alias("n"))
    return lines.filter("n > 1").select("path", F.lit("LINE.REPEATED").alias("rule"), "element", "n").unionByName(empty)


@query
def inventory_delta(spark, sf):
    before, after = map(incremental.manifest, _snapshots(spark, sf))
    folder = F.regexp_extract("path", "^(.*)/", 1).alias("folder")
    return incremental.delta_inventory(incremental.delta(before, after).withColumn("folder", folder), "folder", "type")


@query
def inventory_file(spark, sf):
    """An inventory of all documents as one spreadsheet file in order of their ids, read back."""
    path = f"{new_path(spark, 'inventory')}.csv"
    rows = table(spark, sf, "documents").select("doc_id", "source", "lang", F.length("text").alias("characters"))
    single_file.write_csv(rows, path, ["doc_id"])
    return spark.read.schema("doc_id long, source string, lang string, characters long").option("header", True).option("escape", '"').option("mode", "FAILFAST").csv(path)


@query
def incremental_findings(spark, sf):
    before, after = _snapshots(spark, sf)
    return incremental.scan_changes(after, incremental.manifest(before), stored(_repeated_lines(before), "kept"), _repeated_lines)[1]


def _documents(spark, sf):
    """The documents of the fact tables as audited files."""
    doc = facts.tables(spark, sf, {"doc"})["doc"]
    return doc.select(F.col("doc_id").alias("doc"), F.concat(F.lit("in/"), "doc_id", F.lit("."), "type").alias("path"), "type", (F.col("doc_id") * 700).alias("size_bytes"), "title", "lang", "access_ok", "skip_reason")


def _total(spark, sf) -> int:
    return _documents(spark, sf).count()


def _nodes(spark, sf):
    return facts.tables(spark, sf, {"struct_node"})["struct_node"]


@query
def audit_severity_counts(spark, sf):
    return audits.severity_counts(rule_findings(spark, sf), "type")


@query
def audit_by_severity(spark, sf):
    return audits.by_severity(rule_findings(spark, sf))


@query
def audit_summary(spark, sf):
    """Some findings without a type, and no Markdown ones, so that a type is unknown and one is empty."""
    got = rule_findings(spark, sf, "core", "docx", "xlsx", "pptx", "epub")
    return audits.summary(got.withColumn("type", F.when(F.col("doc") % 7 > 0, F.col("type"))))


@query
def audit_quick_fixes(spark, sf):
    return audits.quick_fixes(rule_findings(spark, sf), _total(spark, sf))


@query
def audit_file_inventory(spark, sf):
    return audits.file_inventory(rule_findings(spark, sf))


@query
def audit_rule_reference(spark, sf):
    return audits.rule_reference(rule_findings(spark, sf), dims.rule_dim(spark))


@query
def audit_manual_review(spark, sf):
    return audits.manual_review(rule_findings(spark, sf))


@query
def audit_remediation_results(spark, sf):
    """Orders as repaired files: scores and counts from their keys, some without a score."""
    k = F.col("o_orderkey")
    files = table(spark, sf, "orders").select(k.alias("doc"), F.when(k % 5 > 0, k % 60).alias("before"), (k % 60 + k % 7 - 2).alias("after"), (k % 4).alias("fixed"), (k % 3).alias("remaining"), (k % 2).alias("needs_human"))
    return audits.remediation_results(files)


@query
def audit_baseline_match(spark, sf):
    part = table(spark, sf, "part")
    return audits.baseline_match(part.select(F.concat(F.lit("p"), F.col("p_partkey") * 2).alias("path")), part.select(F.concat(F.lit("p"), F.col("p_partkey") * 3).alias("path")))


@query
def audit_csv_findings(spark, sf):
    return audits.csv_findings(rule_findings(spark, sf, "core", "xlsx"), _documents(spark, sf), _total(spark, sf))


@query
def audit_csv_scorecard(spark, sf):
    return audits.csv_scorecard(scoring.score_documents(rule_findings(spark, sf).filter("family = 'tools'")), _documents(spark, sf), "2026-01-01T00:00:00Z")


@query
def audit_csv_remediation(spark, sf):
    return audits.csv_remediation(rule_findings(spark, sf), _total(spark, sf), dims.tier_dim(spark))


@query
def audit_md_csv_findings(spark, sf):
    return audits.md_csv_findings(rule_findings(spark, sf, "markdown"), _documents(spark, sf))


@query
def audit_md_csv_scorecard(spark, sf):
    return audits.md_csv_scorecard(rule_findings(spark, sf, "markdown"), _documents(spark, sf), "2026-01-01T00:00:00Z")


@query
def audit_md_csv_remediation(spark, sf):
    return audits.md_csv_remediation(rule_findings(spark, sf, "markdown"))


@query
def audit_tier_badges(spark, sf):
    return audits.tier_badges(rule_findings(spark, sf), dims.tier_dim(spark), _total(spark, sf))


@query
def audit_chosen_models(spark, sf):
    names = F.array(F.lit("a"), F.lit("b"), F.lit("c"), F.lit("d"), F.lit("e"), F.lit("f"), F.lit("x"))
    asked = F.slice(F.concat(names, names), (F.col("p_partkey") % 7 + 1).cast("int"), (F.col("p_size") % 8).cast("int"))
    got = audits.chosen_models(asked, tuple("abcdef"), "a")
    return table(spark, sf, "part").select("p_partkey", got.alias("g")).select("p_partkey", F.array_join("g.models", ",").alias("models"), "g.error")


@query
def audit_error_types(spark, sf):
    status = F.when(F.col("p_partkey") % 5 == 1, 429).when(F.col("p_partkey") % 5 == 2, 503).otherwise(200)
    return table(spark, sf, "part").select("p_partkey", audits.error_type(F.col("p_partkey") % 5 != 3, status).alias("error_type"))


@query
def audit_pixels(spark, sf):
    return table(spark, sf, "part").select("p_partkey", audits.pixels(F.col("p_size"), F.lit(144), F.col("p_partkey") % 10 / 2).alias("px"), audits.confidence_weight(F.element_at(F.array(F.lit("High"), F.lit("medium"), F.lit("LOW"), F.lit(None)), (F.col("p_partkey") % 4 + 1).cast("int"))).alias("weight"))


@query
def audit_tool_errors(spark, sf):
    return audits.tool_errors(facts.tables(spark, sf, {"doc"})["doc"])


@query
def audit_saved_findings(spark, sf):
    """Findings written as one JSON audit per document and read back."""
    path = new_path(spark, "saved")
    audits.write_saved(rule_findings(spark, sf, "core", "markdown"), path)
    return audits.read_saved(spark, path)


@query
def validator_clauses(spark, sf):
    """Line items as failed checks of a validator, by clause and test."""
    clause = F.element_at(F.array(*(F.lit(c) for c in ("7.1", "7.2", "7.3", "7.18.3", "7.21", "7.5", "99.9"))), (F.col("l_orderkey") % 7 + 1).cast("int"))
    checks = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", clause.alias("clause"), (F.col("l_linenumber") % 3 + 1).cast("string").alias("test"), F.when(F.col("l_linenumber") % 2 == 0, "said").otherwise(" ").alias("description"))
    return mapped_clauses(checks).select("l_orderkey", "l_linenumber", "rule", "severity", "wcag", "confidence", "message")


@query
def tree_top_level(spark, sf):
    return tree.top_level(_nodes(spark, sf))


@query
def tree_find(spark, sf):
    return tree.find(_nodes(spark, sf), "Figure", 2).select("doc_id", "node_id")


@query
def tree_content_order(spark, sf):
    """Only the elements of orders name a page; what is below inherits it."""
    own = F.when((F.col("depth") == 2) & (F.col("preorder") % 5 > 0), F.col("page"))
    nodes = _nodes(spark, sf).withColumn("page", own)
    return tree.content_order(nodes)


@query
def tree_misplaced(spark, sf):
    return tree.misplaced(_nodes(spark, sf))


@query
def tree_form_placement(spark, sf):
    return tree.form_placement(_nodes(spark, sf), facts.tables(spark, sf, {"form_field"})["form_field"])


@query
def tree_figure_texts(spark, sf):
    return tree.figure_texts(_nodes(spark, sf))


@query
def planned_fixes(spark, sf):
    return fixes.planned(spark, facts.tables(spark, sf, fixes.needed()))


#: Scanners of the file types that a tool can repair.
_REPAIRED = ("metadata", "tags", "forms", "docx", "xlsx", "pptx", "epub")


def _fix_loop(spark, sf):
    tables = facts.tables(spark, sf, rules.needed(_REPAIRED) | fixes.needed())
    return fix_loop.run(spark, tables, _REPAIRED, before=rule_findings(spark, sf, *_REPAIRED), files=facts.files(spark, sf))


@query
def fix_loop_scores(spark, sf):
    """Every document scanned, repaired as planned and scanned again."""
    return fix_loop.remediation(_documents(spark, sf), *_fix_loop(spark, sf))


@query
def fix_loop_rules(spark, sf):
    """Per rule, what the repairs resolve, leave and add."""
    before, _, after = _fix_loop(spark, sf)
    return analytics.verify_fix(before, after)


def _history(spark, sf):
    """Five times of the same collection: some documents are not looked at, some findings are away."""
    found = rule_findings(spark, sf, *_REPAIRED).select("doc", "rule")
    documents, path, key = _documents(spark, sf), new_path(spark, "history"), F.col("doc") + F.length("rule")
    for time in range(1, 6):
        looked = documents.filter((F.col("doc") * 3 + time * time) % 5 != 0)
        there = found.join(looked.select("doc"), "doc", "left_semi").filter((key * (time + 1) + F.col("doc") % 7) % 3 != time % 3)
        history.append(there, looked, time, path)
    return history.read(spark, path)


@query
def history_statuses(spark, sf):
    return history.statuses(*_history(spark, sf))


@query
def history_as_of(spark, sf):
    """Findings as they stood at the third time, and what had become of them by then."""
    found, scans = _history(spark, sf)
    then = history.as_of(found, scans, 3).select("doc", "rule", "n", "taken")
    return then.join(history.statuses(found, scans, 3).select("doc", "rule", "status"), ["doc", "rule"])


def _shelves(spark, sf):
    """The audited documents in folders of three levels."""
    d = F.col("doc")
    folder = F.concat_ws("/", F.lit("in"), F.concat(F.lit("dept"), (d % 4).cast("string")), F.when(d % 3 > 0, F.concat(F.lit("y"), (d % 5).cast("string"))))
    return _documents(spark, sf).withColumn("path", F.concat(folder, F.lit("/"), d.cast("string"), F.lit("."), "type"))


@query
def folder_patterns(spark, sf):
    return analytics.folder_patterns(rule_findings(spark, sf), _shelves(spark, sf))


@query
def criteria_across_types(spark, sf):
    return analytics.criteria_across_types(rule_findings(spark, sf), _shelves(spark, sf))


@query
def apportioned_quotas(spark, sf):
    return analytics.apportioned(table(spark, sf, "documents"), ["source", "lang"], 20)


@query
def apportioned_sample(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "source", "lang")
    return analytics.apportioned_sample(docs, ["source", "lang"], [F.md5(F.col("doc_id").cast("string")), F.col("doc_id")], 20)


def _prose_lines(spark, sf):
    """Orders as lines of a customer's Markdown text, with bold lines, wide tables, emoji items and dashes."""
    kinds = ("**Terms**", "**a** and **b**", "| a | b | c | d | e |", "text", "| a | b |", "- 😀 good news", "* plain item", "one \u2014 two", "left -- right", "---", "code `a -- b`", "3. ☀ sun", "x\u2013y --- z", "```", "**Late**")
    line = F.element_at(F.array(*(F.lit(k) for k in kinds)), (F.col("o_orderkey") % 15 + 1).cast("int"))
    rows = F.array_sort(F.collect_list(F.struct("o_orderkey", line.alias("line"))))
    texts = table(spark, sf, "orders").groupBy(F.col("o_custkey").cast("long").alias("doc_id")).agg(F.array_join(F.transform(rows, lambda x: x["line"]), "\n").alias("text"))
    return markdown.line_states(texts)


@query
def md_bold_headings(spark, sf):
    return markdown.bold_headings(_prose_lines(spark, sf))


@query
def md_wide_tables(spark, sf):
    return markdown.wide_tables(_prose_lines(spark, sf))


@query
def md_emoji_bullets(spark, sf):
    return markdown.emoji_bullets(_prose_lines(spark, sf))


@query
def md_dashes(spark, sf):
    return markdown.dashes(_prose_lines(spark, sf))


@query
def alt_formats(spark, sf):
    kind = F.element_at(F.array(F.lit("pdf"), F.lit("epub"), F.lit("docx")), (F.col("p_partkey") % 3 + 1).cast("int"))
    got = export.alt_formats(F.concat("p_name", F.lit(' <&">')), F.when(F.col("p_partkey") % 4 > 0, F.concat("p_type", F.lit(" & more"))), kind)
    return table(spark, sf, "part").select("p_partkey", got.alias("g")).select("p_partkey", "g.*")


@query
def audit_text_summaries(spark, sf):
    scored = scoring.score_documents(rule_findings(spark, sf).filter("family = 'tools'"))
    return export.text_summaries(scoring.zero_unreadable(scored, _documents(spark, sf)))


@query
def audit_document_reports(spark, sf):
    got = rule_findings(spark, sf, "core", "xlsx")
    return export.document_reports(got, scoring.score_documents(got))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)
