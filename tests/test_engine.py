"""Layout, extraction, mapping, grading and review on small tables."""

from pyspark.sql import functions as F

from quillstone import schemas
from quillstone.functions import geometry as G
from quillstone.operators import answers as A
from quillstone.operators import grading, layout, mapping, review
from quillstone.operators import questions as Q
from quillstone.plans import assessment
from quillstone.sources import store

BLOCK = "assessment_id string, document_id string, kind string, page_number int, block_id string, text string, bbox struct<x1:double,y1:double,x2:double,y2:double>, confidence double, reading_order int, extraction_method string, position int"


def _blocks(spark, kind, lines):
    """Lines of (page, text, y1, y2, x1)."""
    rows = [("s", kind, kind, page, f"b{i}", text, (x1, y1, 0.9, y2), 0.9, i, "native", i) for i, (page, text, y1, y2, x1) in enumerate(lines)]
    return spark.createDataFrame(rows, BLOCK)


def _flow(texts, page=1):
    return [(page, t, 0.05 + 0.06 * i, 0.09 + 0.06 * i, 0.1) for i, t in enumerate(texts)]


def test_questions(spark):
    lines = _flow(["Biology paper", "11. Cells", "a) Name one", "(2)", "SECTION B", "i) first part [3 marks]", "ii) second", "12. Attempt any one", "12. again"])
    found = {r.normalized_number: r for r in Q.extract_questions(_blocks(spark, "q", lines)).collect()}
    assert list(sorted(found)) == ["11", "11.a", "11.a.i", "11.a.ii", "12", "12.2"]
    assert found["11.a"].max_marks == 2.0 and found["11.a"].text == "Name one"
    assert found["11.a.i"].max_marks == 3.0 and found["11.a.i"].parent_number == "11.a"
    assert found["12"].optional and found["12"].question_id == "q-12"
    assert [r.block_id for r in Q.preamble(layout.ordered_blocks(_blocks(spark, "q", lines).drop("position"))).collect()] == ["b0"]


def test_stems():
    assert Q.stem_numbers(["11", "i", "ii"]) == ["11", "11.i", "11.i.ii"]
    assert Q.stem_numbers(["14.a", "ii", "ii", "b", "a"]) == ["14.a", "14.a.ii", "14.a.ii.2", "14.b", "14.a.2"]


def test_answers_segments_points_and_scope(spark):
    texts = ["17 a) Osmosis is", "water moving", "b) Plasmolysis", "1. first point", "2. second point", "18. Mitosis"]
    rows = A.extract_answers(_blocks(spark, "a", _flow(texts))).orderBy("segment").collect()
    assert [r.detected_label for r in rows] == ["17.a", "17.b", "1", "2", "18"]
    texts = ["5. Causes", "1. first point", "2. second point", "3. third point", "6. Effects"]
    rows = A.extract_answers(_blocks(spark, "a", _flow(texts))).orderBy("segment").collect()
    assert [r.detected_label for r in rows] == ["5", "6"]
    assert rows[0].raw_text == "5. Causes 1. first point 2. second point 3. third point"


def test_continuation_over_pages(spark):
    lines = [(1, "4. Long answer", 0.1, 0.14, 0.1), (1, "that goes on", 0.15, 0.95, 0.1), (2, "and ends here", 0.05, 0.1, 0.1), (2, "5. Next", 0.2, 0.25, 0.1)]
    found = A.extract_answers(_blocks(spark, "a", lines))
    rows = {r.answer_id: r for r in found.collect()}
    assert rows["a-2-1"].is_continuation_of == "a-1-0"
    whole = {r.answer_id: r for r in A.merge_continuations(found).collect()}
    assert set(whole) == {"a-1-0", "a-2-2"}
    assert whole["a-1-0"].page_numbers == [1, 2] and whole["a-1-0"].raw_text.endswith("and ends here")


def test_whole_run(spark):
    paper = _blocks(spark, "question_paper", _flow(["1. Define osmosis in plant cells [2 marks]", "2. Describe mitosis stages [3 marks]", "3. Optional: name a plasmid", "4. Explain photosynthesis light reaction"]))
    sheet = _blocks(spark, "answer_sheet", _flow(["1. osmosis moves water through plant cells", "2. mitosis has stages", "9. unrelated remarks entirely"]))
    run = assessment.process(paper.unionByName(sheet))
    rows = run.mappings.collect()
    assert sorted(r.question_id for r in rows if r.question_id) == ["q-1", "q-2", "q-3", "q-4"]
    assert sorted(r.answer_id for r in rows if r.answer_id) == ["a-1-0", "a-1-1", "a-1-2"]
    direct = {r.question_id: r for r in rows if r.mapping_type == "direct"}
    assert set(direct) == {"q-1", "q-2"} and direct["q-1"].confidence == 0.97
    grades = {r.question_id: r for r in run.grades.collect()}
    assert grades["q-1"].score == 2.0 and grades["q-1"].method == "deterministic"
    results = run.results().first()
    assert results.mappings == len(rows)
    assert run.review().filter("status = 'answered'").count() >= 2


def test_combine_branches(spark):
    cases = [(1.0, 0.0, 0.0, 0.97), (0.0, 0.0, 0.8, 0.68), (0.0, 0.5, 0.5, 0.425), (0.55, 1.0, 1.0, 0.7525), (0.0, 0.05, 0.06, 0.051)]
    df = spark.createDataFrame([c[:3] for c in cases], "a double, b double, c double")
    got = [r[0] for r in df.select(mapping.combine(F.col("a"), F.col("b"), F.col("c"))).collect()]
    assert got == [c[3] for c in cases]


def test_grading_tree(spark):
    m = [("s", "q1", "a1", "direct", "auto_accepted"), ("s", "q2", "a2", "spatial", "needs_review"), ("s", "q3", "a3", "spatial", "needs_review"), ("s", "q4", None, "unanswered", "needs_review"), ("s", None, "a9", "unmatched", "needs_review")]
    mappings = spark.createDataFrame(m, "assessment_id string, question_id string, answer_id string, mapping_type string, review_status string")
    questions = spark.createDataFrame([("s", f"q{i}", "osmosis plant cells", 4.0 if i != 1 else 0.0) for i in range(1, 5)], "assessment_id string, question_id string, text string, max_marks double")
    answers = spark.createDataFrame([("s", "a1", "osmosis plant cells"), ("s", "a2", "osmosis"), ("s", "a3", " ")], "assessment_id string, answer_id string, normalized_text string")
    grades = grading.grade(mappings, questions, answers)
    got = {r.question_id: (r.score, r.max_score, r.method) for r in grades.collect()}
    assert got == {"q1": (1.0, 1.0, "deterministic"), "q2": (2.0, 4.0, "provisional"), "q3": (0.0, 4.0, "skipped"), "q4": (0.0, 4.0, "deterministic")}
    s = grading.summarise(grades, ["assessment_id"]).first()
    assert (s.graded_count, s.held_for_review, s.provisional_count, s.total_score, s.max_score, s.percentage) == (2, 2, 1, 1.0, 5.0, 20.0)
    rubric = spark.createDataFrame([("s", "q1", [("terms", 1.0, ["Osmosis", "membrane"], 0.0)])], schemas.RUBRICS)
    row = grading.grade(mappings, questions, answers, rubric).filter("question_id = 'q1'").first()
    assert row.breakdown[0].rationale == "matched 1/2 rubric terms" and row.feedback == "All rubric criteria were addressed."


def test_columns_do_not_interleave(spark):
    rows = [(1, f"l{i}", 0.1, 0.1 * i + 0.05, 0.4, 0.1 * i + 0.1) for i in range(6)] + [(1, f"r{i}", 0.6, 0.1 * i + 0.04, 0.9, 0.1 * i + 0.1) for i in range(6)]
    boxes = spark.createDataFrame(rows, "g int, id string, x1 double, y1 double, x2 double, y2 double")
    order = [r.id for r in layout.reading_order(boxes, ["g"], "id").orderBy("reading_order").collect()]
    assert order == [f"l{i}" for i in range(6)] + [f"r{i}" for i in range(6)]


def test_boxes_and_transforms(spark):
    one = spark.range(1)
    b = G.normalize(*map(F.lit, (80.0, 50.0, 20.0, 10.0, 100.0, 100.0)))
    row = one.select(b.alias("b"), G.normalize(*map(F.lit, (5.0, 5.0, 5.0, 9.0, 100.0, 100.0))).alias("flat"), G.normalize(*map(F.lit, (1.0, 1.0, 2.0, 2.0, 0.0, 9.0))).alias("page")).first()
    assert tuple(row.b) == (0.2, 0.1, 0.8, 0.5) and row.flat is None and row.page is None
    t = G.then(G.scale(2.0, 4.0), G.translate(1.0, -1.0))
    p = one.select(G.apply(G.invert(t), G.apply(t, F.lit(0.3), F.lit(0.7))["x"], G.apply(t, F.lit(0.3), F.lit(0.7))["y"]).alias("p")).first().p
    assert abs(p.x - 0.3) < 1e-12 and abs(p.y - 0.7) < 1e-12


def test_closure_of_a_long_chain_and_cycles(spark):
    rows = [("a", i, i - 1 if i else None) for i in range(150)] + [("b", 1, 7), ("b", 2, 1), ("b", 3, 4), ("b", 4, 3), ("b", 5, 3), (None, 1, None)]
    found = A.closure(spark, spark.createDataFrame(rows, "g string, n int, p int"), "n", "p", "g")
    got = {(r.g, r.n): (r.root, r.depth) for r in found.collect()}
    assert got == {("a", i): (0, i) for i in range(150)} | {("b", 1): (1, 0), ("b", 2): (1, 1), (None, 1): (1, 0)}


def test_store(spark):
    rows = spark.createDataFrame([("o", 1, "a"), ("o", 2, None), ("p", 1, "a")], "organization_id string, k int, v string")
    assert store.scoped(rows, "o", v=None).count() == 2 and store.scoped(rows, "o", v="a").count() == 1
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "k int, v string, updated_at int")
    new = spark.createDataFrame([(1, "a", 5), (2, "x", 5), (2, "c", 6), (3, "d", 1)], "k int, v string, seq int")
    got = {(r.k, r.v, r.updated_at) for r in store.upsert(old, new, ["k"], stamp=F.lit(9)).collect()}
    assert got == {(1, "a", 1), (2, "c", 9), (3, "d", 9)}
    fixed = review.apply_corrections(
        spark.createDataFrame([("s", "q1", None, "unanswered", 0.0, "needs_review", [], "e")], f"assessment_id string, question_id string, answer_id string, mapping_type string, confidence double, review_status string, regions {schemas.REGIONS}, evidence string"),
        spark.createDataFrame([("s", "q1", "a1", None, "u")], "assessment_id string, question_id string, new_answer string, new_status string, corrected_by string"),
        spark.createDataFrame([("s", "a1", [])], f"assessment_id string, answer_id string, regions {schemas.REGIONS}"),
    ).first()
    assert (fixed.answer_id, fixed.mapping_type, fixed.review_status) == ("a1", "direct", "human_corrected")


def test_params_from_conf(spark):
    spark.conf.set("quillstone.accept", "0.8")
    spark.conf.set("quillstone.review", "high")
    p = schemas.Params.from_conf(spark)
    spark.conf.unset("quillstone.accept")
    spark.conf.unset("quillstone.review")
    assert (p.accept, p.review) == (0.8, 0.45)


def test_replies_stay_in_their_assessment(spark):
    """Ids of questions and answers recur in every assessment; replies go by both."""
    from quillstone.operators import answers, grading

    marks = spark.createDataFrame([(a, "q-1", "Why?", 10.0) for a in "xy"], "assessment_id string, question_id string, text string, max_marks double")
    texts = spark.createDataFrame([(a, "a-1-0", "osmosis", "osmosis", 0.5, None) for a in "xy"], "assessment_id string, answer_id string, raw_text string, normalized_text string, confidence double, detected_label string")
    pairs = spark.createDataFrame([(a, "q-1", "a-1-0", "direct", "auto_accepted") for a in "xy"], "assessment_id string, question_id string, answer_id string, mapping_type string, review_status string")
    rubrics = spark.createDataFrame([("x", "q-1", [("t", 1.0, ["osmosis"], 0.0)]), ("y", "q-1", [("t", 1.0, ["other"], 0.0)])], schemas.RUBRICS)
    found = {r.assessment_id: r.score for r in grading.grade(pairs, marks, texts, rubrics).collect()}
    assert found == {"x": 10.0, "y": 0.0}
    given = spark.createDataFrame([("x", "q-1", 3.0, "f", None), ("y", "q-1", 4.0, "g", None)], schemas.LLM_GRADES)
    rows = grading.grade(pairs, marks, texts, None, given).collect()
    assert sorted((r.assessment_id, r.score, r.feedback) for r in rows) == [("x", 3.0, "f"), ("y", 4.0, "g")]
    repaired = answers.apply_corrections(texts, spark.createDataFrame([("y", "a-1-0", "diffusion")], schemas.CORRECTIONS)).collect()
    assert {r.assessment_id: (r.raw_text, r.confidence) for r in repaired} == {"x": ("osmosis", 0.5), "y": ("diffusion", 0.9)}


def test_degenerate_boxes_have_no_overlap(spark):
    from quillstone.functions import geometry

    point = geometry.box(*[F.lit(0.5)] * 4)
    assert spark.range(1).select(geometry.iou(point, point)).first()[0] == 0.0


def test_uploads(spark):
    from quillstone.sources import store

    png, jpg, pdf = bytes.fromhex("89504E470D0A1A0A") + b"x", bytes.fromhex("FFD8FF") + b"y", b"%PDF-1.7"
    files = [("a", "a/1", png, 1), ("a", "a/2", jpg, 1), ("b", "b/1", pdf, 300), ("c", "c/1", pdf, 2), ("c", "c/2", png, 1), ("d", "d/1", b"", 1), ("e", "e/1", b"GIF8", 1), ("f", "f/1", pdf + b"z" * 90, 1)]
    df = spark.createDataFrame(files, "upload string, path string, content binary, page_count int")
    rows = {r.path: r for r in store.validate_uploads(df, ["upload"], schemas.Params(max_upload_bytes=50)).collect()}
    assert {k: r.problem for k, r in rows.items()} == {"a/1": None, "a/2": None, "b/1": "too many pages", "c/1": "one PDF or images only", "c/2": "one PDF or images only", "d/1": "empty", "e/1": "unsupported type", "f/1": "too large"}
    assert rows["a/1"].mime == "image/png" and rows["a/2"].mime == "image/jpeg" and bytes(rows["b/1"].content) == pdf
