import random

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from lectern.functions import alt_text
from lectern.functions.text import contrast_ratio, is_blank, split_lines, strip
from lectern.operators import analytics, export, markdown, repair, scoring, tree
from lectern.plans import dims
from lectern.streaming import scan

ODD = ["", " a b \t", " x　", "a\r\nb\nc\n", "a\x0bb\x0cc\x1cd\x1de\x1ef\x85g h i", "\n", "\n\n", "one", "\x1fa\x1f", "a\r"]


def test_text_helpers_follow_python(spark):
    rng = random.Random(1)
    texts = ODD + ["".join(rng.choice("ab \t\n\r\x0b\x1c\x1f\x85   ") for _ in range(rng.randrange(12))) for _ in range(300)]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", strip(F.col("t")).alias("s"), split_lines(F.col("t")).alias("l"), is_blank(F.col("t")).alias("b")).collect()
    for r in got:
        assert r.s == r.t.strip() and r.l == r.t.splitlines() and r.b == (not r.t.strip()), repr(r.t)


@pytest.mark.parametrize(
    ("profile", "counts", "want"),
    [("core", (0, 0, 0), (100, "A")), ("core", (1, 0, 0), (95, "A")), ("core", (25, 0, 0), (0, "F")), ("core", (4, 8, 1), (63, "D")), ("tools", (7, 9, 5), (29, "F")), ("core", (3, 4, 0), (77, "C"))],
)
def test_scores(spark, profile, counts, want):
    rows = [(1, s) for s, n in zip(("Error", "Warning", "Info"), counts) for _ in range(n)] or [(1, "none")]
    found = spark.createDataFrame(rows, "doc long, severity string").withColumn("confidence", F.lit(None).cast("string"))
    if not any(counts):
        docs = spark.createDataFrame([(1, True), (2, False)], "doc long, access_ok boolean")
        got = scoring.with_clean_documents(docs, scoring.score_documents(found.limit(0), profile), profile=profile).orderBy("doc").collect()
        assert [(r.score, r.grade) for r in got] == [want, (0, "F")]
    else:
        r = scoring.score_documents(found, profile).first()
        assert (r.score, r.grade) == want


def test_corpus_score_rounds_half_to_even(spark):
    assert tuple(scoring.corpus_score(spark.createDataFrame([(80,), (85,)], "score int")).first()) == (2, 82, "B")
    assert tuple(scoring.corpus_score(spark.createDataFrame([], "score int")).first()) == (0, 0, "F")


def test_alt_text_examples(spark):
    cases = {"": 0, "image": 25, "photo.jpg": 35, "a long walk along the shore at dawn": 93, None: 0}
    got = spark.createDataFrame([(k,) for k in cases], "t string").select("t", alt_text.score(alt_text.flags(F.col("t"))).alias("s")).collect()
    assert {r.t: r.s for r in got} == cases


def test_verify_fix_keeps_its_sums(spark):
    make = lambda rows: spark.createDataFrame(rows, "doc long, rule string")
    got = analytics.verify_fix(make([(1, "a")] * 3 + [(1, "b")]), make([(1, "a"), (1, "b"), (1, "b"), (1, "b"), (1, "c")])).collect()
    assert {r.rule: (r.before, r.after, r.resolved, r.remaining, r.added) for r in got} == {"a": (3, 1, 2, 1, 0), "b": (1, 3, 0, 3, 2), "c": (0, 1, 0, 0, 1)}


def test_heading_operators(spark):
    h = spark.createDataFrame([("a", i, v) for i, v in enumerate((1, 3, 2, 4))] + [("b", i, v) for i, v in enumerate((2, 3))], "doc string, ord int, level int")
    assert [(r.doc, r.ord) for r in tree.heading_skips(h, "doc", "level", "ord").orderBy("doc", "ord").collect()] == [("a", 1), ("a", 3)]
    assert [tuple(r) for r in tree.heading_holes(h, "doc", "level").collect()] == [("b", 1)]
    assert sorted((r.doc, r.ord, r.missing) for r in tree.unseen_levels(h, "doc", "level", "ord").collect()) == [("a", 1, 2), ("b", 0, 1), ("b", 1, 1)]
    fixed = {r.doc: r.repaired for r in repair.heading_repairs(h, "doc", "ord", "level").collect()}
    assert fixed == {"a": [1, 2, 2, 3], "b": [2, 3]}


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(0, 30), max_size=40))
def test_inversions(values):
    import numpy as np

    want = sum(values[i] > values[j] for i in range(len(values)) for j in range(i + 1, len(values)))
    assert tree._inversions(np.array(values, int)) == want


def test_deep_tree_and_linear_reading(spark):
    deep = [(1, i, i - 1 if i else None, 0, "Sect", [], False, None, None, 1) for i in range(104)]
    table = [(2, 0, None, 0, "Document", [], False, None, None, 1), (2, 1, 0, 1, "Table", [], False, None, None, 1), (2, 2, 1, 0, "TR", [], False, None, None, 1), (2, 3, 2, 0, "TH", [1], False, "Name", None, 1), (2, 4, 2, 1, "TH", [2], False, None, "Age", 1), (2, 5, 0, 0, "P", [0], False, None, "Hello", 1)]
    nodes = tree.labelled(spark.createDataFrame(deep + table, "doc_id long, node_id int, parent_id int, ord int, tag string, mcids array<int>, has_objr boolean, alt string, actual_text string, page int")).cache()
    assert nodes.filter("doc_id = 1 and node_id = 103").first().depth == 104 and nodes.filter("doc_id = 1 and node_id = 0").first().post == 104
    lines = [r.line for r in tree.linearised(nodes.filter("doc_id = 2")).collect()]
    assert lines == ["P Hello (p.1)", "table with 1 rows and 2 columns", "TR (p.1)", "TH Name (p.1)", "TH Age (p.1)"]
    assert [r.node_id for r in tree.leaves(nodes.filter("doc_id = 2")).orderBy("place").collect()] == [5, 3, 4]


def test_markdown_extras(spark):
    text = "# One two\n## One two\n[a](#one-two) [b](#one-two-1) [c](#none)\n[More](x) [more](y)\n\n" + "word " * 160 + "\n"
    state = markdown.line_states(spark.createDataFrame([(1, text)], "doc_id long, text string"))
    assert [r.anchor for r in markdown.broken_anchors(state).collect()] == ["none"]
    assert [(r.text, r.urls) for r in markdown.repeated_link_texts(state).collect()] == [("more", 2)]
    assert [(r.words, r.longest_sentence) for r in markdown.long_passages(state).collect()] == [(160, 160)]


def test_plans_and_exports(spark, tmp_path):
    tiers = dims.tier_dim(spark, generator=True)
    assert tiers.filter("rule = 'DOCX-IMG.ALT'").first().tier == 2 and dims.tier_dim(spark).filter("rule = 'XLSX.META.TITLE'").first().fixer_rule == "XLSX-META.TITLE"
    assert dims.rule_dim(spark).count() == 131 and dims.criterion_dim(spark).count() == 20
    spine = spark.createDataFrame([(1, i, r) for i, r in enumerate("abac")], "doc_id long, ord int, idref string")
    items = spark.createDataFrame([(1, "a"), (1, "b")], "doc_id long, item_id string")
    assert sorted(r.idref for r in repair.clean_spine(spine, items).collect()) == ["a", "b"]
    titles = repair.numbered_titles(spark.createDataFrame([(1, 1, "T"), (1, 2, "T"), (1, 3, "t")], "doc_id long, slide_no int, title string"))
    assert sorted(r.new_title for r in titles.collect()) == ["T", "T (2)", "t"]
    found = spark.createDataFrame([(1, 1, "f", "R", "Error", None, "1.1.1", 2, 'say "x"')], "doc long, ord long, file string, rule string, severity string, confidence string, wcag string, page int, message string")
    export.write_csv(found, str(tmp_path / "out"))
    raw = b"".join(p.read_bytes() for p in (tmp_path / "out").glob("*.csv"))
    assert b'"f","R","Error","","1.1.1","2","say ""x"""\r\n' in raw
    scored = scoring.score_documents(found)
    assert '"grade":"A"' in export.audit_json(found, scored).first().json
    form = spark.createDataFrame([('a "b" <c>', None)], "t string, d string").select(export.alt_formats(F.col("t"), F.col("d"), F.lit("pdf")).alias("f")).first().f
    assert form.html.startswith('<img src="" alt="a &quot;b&quot; &lt;c&gt;" />') and form.markdown == '![a "b" <c>]()' and form.plain == 'Alt: a "b" <c>'
    more = found.unionByName(found.withColumn("rule", F.lit("X")))
    names = spark.createDataFrame([("R", "name of R"), ("R", "twice")], "rule string, name string")
    both = export.with_remedies(more.withColumn("fix", F.when(F.col("rule") == "X", "fix_pdf")), names)
    export.write_audiences(both, str(tmp_path / "two"))
    tool, manual = (b"".join(p.read_bytes() for p in (tmp_path / f"two-{a}").glob("*.csv")) for a in ("tool", "manual"))
    for raw in (tool, manual):
        assert raw.count(b'"f","R"') == raw.count(b'"f","X"') == 1 and b'"remediation"' in raw
    assert tool.count(b"Run fix_pdf") == 1 and not manual.count(b"Run ") and manual.count(b"by hand on page 2") == 2


def test_families_are_scored_apart_and_unreadable_files_score_nothing(spark):
    docs = spark.createDataFrame([(1, "pdf", True), (2, "pdf", False), (3, "docx", True)], "doc long, type string, access_ok boolean")
    found = spark.createDataFrame([(1, "core", "Error", "High")] * 2 + [(1, "tools", "Error", "High"), (2, "tools", "Error", "High")], "doc long, family string, severity string, confidence string")
    got = {(r.family, r.doc): (r.errors, r.score, r.grade) for r in scoring.score_families(found, docs).collect()}
    assert got == {("core", 1): (2, 90, "A"), ("core", 2): (0, 0, "F"), ("tools", 1): (1, 90, "A"), ("tools", 2): (1, 0, "F"), ("tools", 3): (0, 100, "A")}
    scored = scoring.zero_unreadable(scoring.score_documents(found.filter("family = 'tools'")), docs).collect()
    assert {r.doc: (r.score, r.grade) for r in scored} == {1: (90, "A"), 2: (0, "F")}


def test_contrast(spark):
    black, white = [F.lit(0)] * 3, [F.lit(255)] * 3
    r = spark.range(1).select(contrast_ratio(black, white).alias("a"), contrast_ratio(white, white).alias("b")).first()
    assert abs(r.a - 21) < 1e-9 and r.b == 1


def test_stream_of_texts_equals_the_batch(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    for i in range(3):
        (folder / f"{i}.md").write_text("Name " + "_" * 20 + "\n" + ("_" * 15 + "\n") * i)
    stream = scan.fill_lines(scan.text_stream(spark, str(folder)))
    q = stream.writeStream.format("memory").queryName("fills").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(r.fill_lines for r in spark.table("fills").collect()) == [1, 2, 3]


def test_stream_windows_equal_the_batch(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("ts", "event_type", "user_id")
    events.repartition(3).write.parquet(str(tmp_path / "events"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "events"))
    q = scan.windowed(stream, "1 hour", late="40 days").writeStream.format("memory").queryName("hours").outputMode("complete").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(map(str, spark.table("hours").collect())) == sorted(map(str, scan.windowed(events, "1 hour").collect()))


def test_inversion_rates_of_small_and_large_pages(spark):
    rng = random.Random(3)
    tree_rows, paint_rows, want = [], [], {}
    for page, n in enumerate((1, 2, 10, 64, 65, 300)):
        order = list(range(n))
        rng.shuffle(order)
        tree_rows += [(1, page, i, i) for i in range(n)] + [(1, page, n, 0)]  # content 0 counts at its last place
        paint_rows += [(1, page, i, m) for i, m in enumerate(order)]
        places = [n if m == 0 else m for m in order]
        bad = sum(places[i] > places[j] for i in range(n) for j in range(i + 1, n))
        want[page] = (n, 2 * bad / (n * (n - 1)) if n > 1 else 0.0)
    make = lambda rows: spark.createDataFrame(rows, "doc_id long, page int, pos int, mcid int")
    assert {r.page: (r.n, r.rate) for r in tree.inversion_rates(make(tree_rows), make(paint_rows)).collect()} == want


def test_model_answers(spark):
    from lectern.functions.alt_text import parsed

    rows = [('<img><figcaption>a</figcaption><figcaption> b <i>c</i></figcaption><img alt="x">',), ("```\n<img alt='é &lt; '/>\n```",), ("<img alt><img alt='two'>",), ("",), (None,)]
    got = [tuple(r.g) for r in spark.createDataFrame(rows, "t string").select(parsed(F.col("t")).alias("g")).collect()]
    assert got == [("", "b  c", True), ("é <", "", True), ("two", "", True), (None, None, False), (None, None, False)]


def test_images_without_any_text_or_row(spark):
    from lectern.operators import images

    found = spark.createDataFrame([(1, 1, 0, 60, 60, b"BMx"), (1, 1, 1, 60, 60, b"BMx"), (1, 2, 0, 10, 60, b"y"), (None, None, 0, 60, 60, None)], "doc_id long, page int, idx int, width int, height int, content binary")
    texts = spark.createDataFrame([], "doc_id long, page int, ord int, alt string")
    got = images.with_existing(images.to_describe(found), texts).select("idx", images.mime(F.col("content")).alias("m"), "existing_alt").collect()
    assert [tuple(r) for r in got] == [(0, "image/bmp", None)]
    assert images.with_existing(images.to_describe(found.limit(0)), texts).count() == 0


def test_reports_of_nothing(spark):
    from lectern.operators import reports

    findings = spark.createDataFrame([], "doc long, type string, rule string, severity string")
    assert reports.key_problems(findings).count() == 0
    assert reports.profile(findings, "minimal").count() == 0
    fields = spark.createDataFrame([(1, None, None, None, None)], "doc_id long, ft string, tooltip string, name string, ff int")
    assert reports.form_summary(fields).first().asDict() == {"doc_id": 1, "total": 1, "missing_tooltip": 1, "missing_name": 1, "required": 0, "types": "Unknown:1", "has_tooltips": 0}
