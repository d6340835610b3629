"""Patches, the fix loop and findings over time on small tables."""

import pytest

from lectern.operators import fix_loop, history
from lectern.plans import rules
from lectern.sources.schema import SCHEMAS
from lectern.storage import new_path, views
from tests.test_rules import grow, names, run


def table(spark, name, *rows):
    return spark.createDataFrame([tuple(r.get(c) for c in names(name)) for r in rows], SCHEMAS[name])


def test_last_writer_wins_and_the_rest_stays(spark):
    slides = table(spark, "slide", dict(doc_id=1, slide_no=1, title=""), dict(doc_id=1, slide_no=2, title="x"), dict(doc_id=None, slide_no=1, title=""), dict(doc_id=2, slide_no=1, title=None))
    kind = "table string, doc_id long, content_doc string, number int, field string, value string, seq int"
    changes = spark.createDataFrame([("slide", 1, "", 1, "title", "late", 9), ("slide", 1, "", 1, "title", "early", 3), ("slide", 1, "", 2, "title", None, 3), ("slide", 7, "", 1, "title", "none", 1), ("doc", 2, "", 1, "title", "other", 1)], kind)
    got = {(r.doc_id, r.slide_no): r.title for r in fix_loop.patched(slides, "slide", changes).collect()}
    assert got == {(1, 1): "late", (1, 2): "x", (None, 1): "", (2, 1): None}
    assert fix_loop.patched(slides, "slide", changes).schema == slides.schema
    assert fix_loop.patched(slides.limit(0), "slide", changes).count() == 0


def test_arrays_grow_rows_drop_and_headings_are_renamed(spark):
    tables = {
        "epub_pkg": table(spark, "epub_pkg", dict(doc_id=1, title="B", language="en", creator="C", version="3.0", metas=[("schema:accessMode", "a=b")], nav_present=False)),
        "epub_spine": table(spark, "epub_spine", dict(doc_id=1, ord=1, idref="a"), dict(doc_id=1, ord=2, idref="a"), dict(doc_id=1, ord=3, idref="gone")),
        "epub_item": table(spark, "epub_item", dict(doc_id=1, item_id="a", href="c.xhtml", part="c")),
        "html_el": table(spark, "html_el", *(dict(doc_id=1, content_doc="c", ord=i, post=i, el=e, attrs={}) for i, e in enumerate(["h1", "p", "h4", "h5"]))),
    }
    before, plan, after = fix_loop.run(spark, tables, ("epub",))
    left = {r.rule for r in after.collect()}
    assert {"EPUB-E004", "EPUB-E006", "EPUB-E007", "EPUB-W003"} <= {r.rule for r in before.collect()}
    assert not left & {"EPUB-E004", "EPUB-W003"}
    out = fix_loop.apply_plan(spark, tables, plan)
    assert [(m.property, m.text) for m in out["epub_pkg"].first().metas][:2] == [("schema:accessMode", "a=b"), ("schema:accessibilityFeature", "structuralNavigation")]
    assert [r.el for r in out["html_el"].orderBy("ord").collect()] == ["h1", "p", "h2", "h3"]
    assert [(r.ord, r.idref) for r in out["epub_spine"].collect()] == [(1, "a")]


def test_tables_of_contents_and_image_texts(spark):
    """Per book: first headings in reading order, file names where there are none, nothing to list, old versions, repeats."""
    pkg = lambda d, **m: dict(doc_id=d, version="3.0", title="B", language="en", creator="C", nav_present=True, nav_types=[]) | m
    item = lambda d, i, href, part: dict(doc_id=d, item_id=i, href=href, part=part)
    el = lambda d, part, o, e, text, **attrs: dict(doc_id=d, content_doc=part, ord=o, post=o, el=e, attrs=attrs, inner_text=text)
    tables = {
        "epub_pkg": table(spark, "epub_pkg", pkg(1), pkg(2), pkg(3, version="2.0"), pkg(4, nav_types=["toc"]), pkg(5, nav_present=None, version=None)),
        "epub_item": table(spark, "epub_item", item(1, "a", 'x/"a".xhtml', "o/a"), item(1, "b", "two_words-3rd.x.xhtml", "o/b"), item(1, "c", "c.xhtml", "o/c"), item(1, "d", None, None), item(3, "a", "a", "a"), item(5, "a", ".hidden", None)),
        "epub_spine": table(spark, "epub_spine", *(dict(doc_id=1, ord=i, idref=x) for i, x in enumerate(["b", "a", "gone", "d", "c", "a"])), dict(doc_id=2, ord=0, idref="a"), dict(doc_id=3, ord=0, idref="a"), dict(doc_id=5, ord=0, idref="a")),
        "html_el": table(spark, "html_el", el(1, "o/a", 3, "h1", "Late"), el(1, "o/a", 1, "h4", " A < B & C "), el(1, "o/c", 0, "h2", "  "), el(1, "o/b", 0, "p", "x"), el(1, "o/b", 1, "img", "", src="p.png", role="img"), el(1, "o/b", 2, "img", "", alt=""), el(2, "o/b", 1, "img", "")),
    }
    before, plan, after = fix_loop.run(spark, tables, ("epub",))
    nav = {r.doc: (r.status, r.new) for r in plan.filter("rule = 'EPUB-E004'").collect()}
    a = '<li><a href="x/&quot;a&quot;.xhtml">A &lt; B &amp; C</a></li>'
    assert nav == {1: ("fixed", f'<ol><li><a href="two_words-3rd.x.xhtml">Two Words 3Rd.X</a></li>{a}<li><a href="c.xhtml">Heading 2</a></li>{a}</ol>'), 2: ("needs-human", None), 5: ("fixed", '<ol><li><a href=".hidden">.Hidden</a></li></ol>')}
    assert sorted((r.doc, r.target, r.new) for r in plan.filter("rule = 'EPUB-E005'").collect()) == [(1, "o/b element 1", "TODO: Describe p.png"), (2, "o/b element 1", "TODO: Describe image")]
    out = fix_loop.apply_plan(spark, tables, plan)["html_el"].filter("el = 'img'").orderBy("doc_id", "ord").collect()
    assert [r.attrs for r in out] == [{"src": "p.png", "role": "img", "alt": "TODO: Describe p.png"}, {"alt": ""}, {"alt": "TODO: Describe image"}]
    assert {r.doc for r in before.filter("rule = 'EPUB-E004'").collect()} >= {1, 2, 5} and not {1, 5} & {r.doc for r in after.filter("rule = 'EPUB-E004'").collect()}


def test_only_what_is_wanted_is_repaired(spark):
    tables = {"doc": table(spark, "doc", dict(doc_id=1, type="docx", access_ok=True), dict(doc_id=2, type="docx", access_ok=True), dict(doc_id=3, type="docx", access_ok=False))}
    wanted = spark.createDataFrame([(1, "DOCX-META.TITLE"), (2, "DOCX-META.LANG")], "doc long, rule string")
    before, plan, after = fix_loop.run(spark, tables, ("docx",), wanted=wanted)
    assert sorted((r.doc, r.rule) for r in after.collect()) == [(1, "DOCX-META.LANG"), (2, "DOCX-META.TITLE")]
    documents = tables["doc"].selectExpr("doc_id AS doc", "access_ok")
    got = {r.doc: (r.score_before, r.score_after, r.fixed, r.delta) for r in fix_loop.remediation(documents, before, plan, after).collect()}
    assert got == {1: (80, 90, 1, 10), 2: (80, 90, 1, 10), 3: (0, 0, 0, 0)}


def test_history_with_gaps(spark):
    path = new_path(spark, "history")
    found = lambda *rows: spark.createDataFrame(list(rows), "doc long, rule string")
    docs = lambda *ids: spark.createDataFrame([(i,) for i in ids], "doc long")
    history.append(found((1, "A"), (1, "B"), (1, "B"), (2, "A")), docs(1, 2), 1, path)
    history.append(found((1, "B")), docs(1), 2, path)  # document 2 is not looked at
    history.append(found((1, "A"), (1, "C"), (2, "A"), (3, "A")), docs(1, 2, 3), 3, path)
    stored_, scans = history.read(spark, path)
    got = {(r.doc, r.rule): (r.status, r.first_seen, r.last_seen, r.scans) for r in history.statuses(stored_, scans).collect()}
    assert got == {(1, "A"): ("Regressed", 1, 3, 2), (1, "B"): ("Fixed", 1, 2, 2), (1, "C"): ("New", 3, 3, 1), (2, "A"): ("Persistent", 1, 3, 2), (3, "A"): ("New", 3, 3, 1)}
    assert sorted((r.doc, r.rule, r.taken) for r in history.as_of(stored_, scans, 2).collect()) == [(1, "B", 2), (2, "A", 1)]
    total = history.counts(history.statuses(stored_, scans), "doc").orderBy("doc").collect()
    assert [(r.new, r.persistent, r.regressed, r.fixed) for r in total] == [(1, 0, 1, 1), (0, 1, 0, 0), (1, 0, 0, 0)]
    assert history.statuses(stored_.limit(0), scans).count() == 0


def test_views_come_back(spark):
    spark.range(3).createOrReplaceTempView("doc")
    with views({"doc": spark.range(5), "slide": spark.range(1)}):
        assert spark.table("doc").count() == 5
    assert spark.table("doc").count() == 3 and not spark.catalog.tableExists("slide")
    spark.catalog.dropTempView("doc")


def test_conditions_on_one_table_share_a_scan(spark, tmp_path):
    table(spark, "doc", dict(doc_id=1, type="pdf", access_ok=True)).write.parquet(f"{tmp_path}/doc")
    found = rules.findings(spark, {"doc": spark.read.parquet(f"{tmp_path}/doc")}, ("metadata",))
    assert found._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1
    assert found.count() == 5


@pytest.mark.parametrize("depth", [5, 400])
def test_nested_tables_and_sections(spark, depth):
    """A header cell counts for each table around it; a table without one inside is told."""
    nested = grow(1, *(("Table", i + 1) for i in range(depth)), ("TH", depth + 1), ("Table", 1)) + grow(2, *(("Sect", i + 1) for i in range(depth)))
    got = run(spark, ("core",), struct_node=nested)
    assert sum(r[1] == "PDFBP.TABLE_SCOPE" for r in got) == depth
    assert [r[5] for r in got if r[1] == "PDFBP.TABLE_HEADERS"] == [str(depth + 1)]
    assert [(r[0], r[6]) for r in got if r[1] == "PDFBP.SECT_NESTING"] == [(2, depth)]


def test_repairs_move_no_table_that_lies_by_documents_and_rescan_only_what_they_touch(spark):
    from lectern.plans import fixes
    from lectern.storage import by_documents, table_by

    els = table(spark, "html_el", *(dict(doc_id=d, content_doc="c", ord=i, post=i, el=e, attrs={}) for d in range(9) for i, e in enumerate(["h1", "img", "h4", "h5"])))
    lying = spark.table(table_by(els.repartition(3, "doc_id"), "html", 3))
    changes = fix_loop.patches(spark, fixes.planned(spark, {"html_el": els}, ("fix_epub",)))
    assert changes.count() == 27  # two headings and an image a document
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        with by_documents(spark):
            got = fix_loop.patched(lying, "html_el", spark.table(table_by(changes.repartition(3, "doc_id"), "changes", 3)), 3)
            plan = got._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("Exchange") == 1  # the patches' own
    rows = lambda df: sorted((r.doc_id, r.ord, r.el, r.attrs.get("alt")) for r in df.collect())
    assert rows(got) == rows(fix_loop.patched(els, "html_el", changes))
    assert [r[2] for r in rows(got)[:4]] == ["h1", "img", "h2", "h3"]
    same = spark.createDataFrame([(1, "docx", "DOCX-LIST.SEMANTIC", "no table of it is repaired"), (1, "docx", "DOCX-META.TITLE", "repaired")], "doc long, scanner string, rule string, message string")
    before = rules.findings(spark, {}, ("docx",)).limit(0).unionByName(same, allowMissingColumns=True)
    assert [r.message for r in fix_loop.scanned(spark, {}, ("docx",), "after", before).collect()] == ["no table of it is repaired"]
