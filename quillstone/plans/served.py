"""Queries of the reads behind the routes, with their SQL; see catalog."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..operators import grading, served
from ..sources import store
from .catalog import Tables, query, sql_up

#: One row per order and line number.
LINES = "(SELECT l_orderkey, l_linenumber, min(l_quantity) AS l_quantity, min(l_returnflag) AS l_returnflag, min(l_linestatus) AS l_linestatus, min(l_discount) AS l_discount FROM lineitem GROUP BY 1, 2)"


def order_lines(t: Tables) -> DataFrame:
    names = ("l_quantity", "l_returnflag", "l_linestatus", "l_discount")
    return t.lineitem.groupBy("l_orderkey", "l_linenumber").agg(*[F.min(c).alias(c) for c in names])


@query("SELECT l_orderkey AS assessment_id, count(*) AS mapping_count, count(*) FILTER (l_returnflag = 'R') AS needs_review, count(*) FILTER (l_linestatus = 'O') AS unanswered, 0 AS unmatched, max(l_quantity) AS total_score, max(l_extendedprice) AS max_score, min(l_tax) AS percentage FROM lineitem GROUP BY 1")
def wire_results(t: Tables) -> DataFrame:
    rows = t.lineitem.groupBy(F.col("l_orderkey").alias("assessment_id")).agg(
        F.count(F.lit(1)).alias("mappings"), F.count_if(F.col("l_returnflag") == "R").alias("needs_review"), F.count_if(F.col("l_linestatus") == "O").alias("unanswered"),
        F.lit(0).alias("unmatched"), F.max("l_quantity").alias("total_score"), F.max("l_extendedprice").alias("max_score"), F.min("l_tax").alias("percentage"),
    )
    return served.wire(rows, "results")


@query("""SELECT '{"job_id":' || o_orderkey || ',"assessment_id":' || o_custkey || ',"stage":"' || o_orderpriority || '","status":"' || o_orderstatus || '","progress":' || CASE WHEN o_orderstatus = 'F' THEN '1' ELSE '0' END || ',"error":null}' AS json FROM orders""")
def wire_jobs(t: Tables) -> DataFrame:
    rows = t.orders.select(
        F.col("o_orderkey").alias("job_id"), F.col("o_custkey").alias("assessment_id"), F.col("o_orderpriority").alias("stage"), F.col("o_orderstatus").alias("status"),
        F.when(F.col("o_orderstatus") == "F", 1).otherwise(0).alias("progress"), F.lit(None).cast("string").alias("error"),
    )
    return store.wire_json(rows, {name: name for name in served.WIRE["job"]})


@query("SELECT event_type, CASE event_type WHEN 'click' THEN 'rendering-pages' ELSE 'rendering-pages' END AS shown, count(*) AS n FROM events GROUP BY 1 UNION ALL SELECT 'mapping', 'mapping-grading', 1 UNION ALL SELECT 'question_extraction', 'extracting-questions', 1 UNION ALL SELECT 'answer_extraction', 'extracting-answers', 1 UNION ALL SELECT 'done', 'done', 1")
def stage_shown(t: Tables) -> DataFrame:
    some = t.spark.createDataFrame([(s,) for s in ("mapping", "question_extraction", "answer_extraction", "done")], "event_type string")
    rows = t.events.select("event_type").union(some).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    return rows.withColumn("shown", served.shown_stage(F.col("event_type")))


@query("SELECT o_orderkey, o_custkey % 7 AS tenant, o_custkey AS outside, c.c_nationkey AS inside FROM orders LEFT JOIN customer c ON c.c_custkey = o_custkey AND c.c_custkey % 3 <> 0")
def external_ids(t: Tables) -> DataFrame:
    ids = t.customer.filter("c_custkey % 3 <> 0").select((F.col("c_custkey") % 7).alias("tenant"), F.col("c_custkey").alias("external_id"), F.col("c_nationkey").alias("id"))
    rows = t.orders.select("o_orderkey", (F.col("o_custkey") % 7).alias("tenant"), F.col("o_custkey").alias("outside"))
    return served.internal_ids(rows, ids, ["tenant"], "outside", "inside")


@query("SELECT o_orderkey AS job_id, o_custkey AS assessment_id FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def job_within_assessment(t: Tables) -> DataFrame:
    jobs = t.orders.select(F.col("o_orderkey").alias("job_id"), F.col("o_custkey").alias("assessment_id"))
    return served.within(jobs, t.customer.filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("assessment_id")), ["assessment_id"])


@query("SELECT s_suppkey, lower(s_name) || '@x.org' AS email, true AS is_active FROM supplier WHERE s_acctbal > 0 AND lower(s_name) || '@x.org' = (SELECT lower(min(s_name)) || '@x.org' FROM supplier WHERE s_acctbal > 0)")
def active_user(t: Tables) -> DataFrame:
    users = t.supplier.select("s_suppkey", F.concat("s_name", F.lit("@X.org")).alias("email"), (F.col("s_acctbal") > 0).alias("is_active"))
    first = users.filter("is_active").agg(F.min("email")).first()[0] or ""
    return served.active_users(users, f" {first.upper()} ").withColumn("email", F.lower("email"))


@query("SELECT l_orderkey AS document_id, l_linenumber AS page_number, l_partkey, CASE WHEN l_linenumber <= 3 AND o_orderkey IS NOT NULL THEN 'p/' || o_orderkey || '/' || l_linenumber END AS uri FROM lineitem LEFT JOIN orders ON o_orderkey = l_orderkey")
def page_image_uris(t: Tables) -> DataFrame:
    pages = t.orders.select(F.col("o_orderkey").alias("document_id"), F.explode(F.sequence(F.lit(1), F.lit(3))).alias("page_number"))
    pages = pages.withColumn("uri", F.concat_ws("/", F.lit("p"), "document_id", "page_number"))
    artifacts = t.lineitem.select(F.col("l_orderkey").alias("document_id"), F.col("l_linenumber").alias("page_number"), "l_partkey")
    return served.page_uris(artifacts, pages, ["document_id"])


@query("SELECT p_partkey AS question_id FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_returnflag <> 'N')")
def unanswered_list(t: Tables) -> DataFrame:
    kinds = F.when(F.col("l_returnflag") == "N", "unanswered").otherwise("direct")
    mappings = t.lineitem.select(F.col("l_partkey").alias("question_id"), kinds.alias("mapping_type"))
    return served.unanswered_questions(t.part.select(F.col("p_partkey").alias("question_id")), mappings, ["question_id"])


@query("SELECT p_partkey, len(generate_series(0, greatest(0, p_size // 10))) AS options, list_sum(generate_series(0, greatest(0, p_size // 10)))::BIGINT AS total FROM part")
def score_choices(t: Tables) -> DataFrame:
    options = served.score_options(F.col("p_size") / 10)
    return t.part.select("p_partkey", F.size(options).cast("long").alias("options"), F.aggregate(options, F.lit(0).cast("long"), lambda a, x: a + x).alias("total"))


@query(f"""SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber = 1 THEN l_quantity % 6 ELSE l_quantity END AS score, CASE WHEN l_returnflag = 'R' THEN NULL ELSE l_quantity END AS max_score,
CASE WHEN l_linenumber <> 1 THEN NULL WHEN l_quantity % 6 = CASE WHEN l_returnflag = 'R' THEN 5 ELSE l_quantity END THEN true WHEN l_quantity % 6 = 0 THEN false END AS is_correct,
CASE WHEN l_linenumber = 1 THEN 'human_corrected' ELSE 'needs_review' END AS review_status FROM {LINES}""")
def score_override(t: Tables) -> DataFrame:
    lines = order_lines(t)
    rows = lines.select(
        "l_orderkey", "l_linenumber", F.col("l_quantity").alias("score"), F.when(F.col("l_returnflag") != "R", F.col("l_quantity")).alias("max_score"),
        F.lit(None).cast("boolean").alias("is_correct"), F.lit("needs_review").alias("review_status"),
    )
    own = lines.filter("l_linenumber = 1").select("l_orderkey", "l_linenumber", (F.col("l_quantity") % 6).alias("score"))
    return served.override_scores(rows, own, ["l_orderkey", "l_linenumber"])


@query(f"""SELECT o_custkey, coalesce(sum(CASE WHEN o_orderstatus = 'F' THEN o_totalprice END), max(o_totalprice)) > 0 AS scored, bool_or(o_orderstatus = 'O') AS any_answered,
{sql_up("sum(o_orderkey) / CAST(1048576 AS DOUBLE)", 2)} AS mb FROM orders GROUP BY 1""")
def client_totals(t: Tables) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "O", "answered").otherwise("unanswered")
    total = served.scored_total(F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice")), F.col("o_totalprice"))
    return t.orders.groupBy("o_custkey").agg((total > 0).alias("scored"), served.group_answered(status).alias("any_answered"), served.size_mb(F.col("o_orderkey")).alias("mb"))


@query("SELECT count(*) > 0 AS found FROM orders WHERE o_orderstatus = 'P'")
def existence(t: Tables) -> DataFrame:
    return served.exists(t.orders, F.col("o_orderstatus") == "P")


@query("""SELECT doc_id, len(string_split(text, chr(10))) = 3 AS same, CASE WHEN lang = 'de' OR lang IS NULL THEN 'title' WHEN doc_id % 3 = 0 THEN 'files' END AS problem FROM documents WHERE text IS NOT NULL""")
def reply_and_upload_checks(t: Tables) -> DataFrame:
    asked = F.array(F.lit(1), F.lit(2), F.lit(3))
    title = F.when(F.col("lang") == "de", "  ").otherwise(F.col("lang"))
    problem = served.upload_problem(title, (F.col("doc_id") % 3).cast("int"))
    return t.documents.filter("text is not null").select("doc_id", served.same_length(asked, F.split("text", "\n", -1)).alias("same"), problem.alias("problem"))


@query(f"SELECT l_orderkey, l_linenumber FROM {LINES} WHERE l_discount < 0.03 AND l_quantity / 50 < 0.9")
def remaining_low_confidence(t: Tables) -> DataFrame:
    lines = order_lines(t)
    flagged = lines.filter("l_discount < 0.03").select("l_orderkey", "l_linenumber")
    return served.still_low(flagged, lines.withColumn("confidence", F.col("l_quantity") / 50), ["l_orderkey", "l_linenumber"])


@query("""SELECT conv_id, string_agg(n || '. "' || text || '"' || CASE WHEN turn % 3 = 0 THEN ' [LOW CONFIDENCE]' ELSE '' END, chr(10) ORDER BY turn) AS lines
FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations WHERE text IS NOT NULL) GROUP BY 1""")
def prompt_lines(t: Tables) -> DataFrame:
    rows = t.conversations.filter("text is not null").withColumn("confidence", F.when(F.col("turn") % 3 == 0, 0.5).when(F.col("turn") % 3 == 1, 0.65))
    return served.numbered_lines(rows, ["conv_id"], "turn", "text", "confidence")


@query("""WITH e AS (SELECT o_custkey, o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN 'questions' WHEN 1 THEN 'answers' WHEN 2 THEN 'mapping' WHEN 3 THEN 'grading' WHEN 4 THEN 'queued' ELSE 'done' END AS stage,
o_orderkey % 11 = 0 AS bad FROM orders),
p AS (SELECT *, CASE stage WHEN 'questions' THEN 0.2 WHEN 'answers' THEN 0.5 WHEN 'mapping' THEN 0.75 WHEN 'grading' THEN 0.9 WHEN 'done' THEN 1.0 END::DOUBLE AS reached FROM e),
f AS (SELECT *, min(CASE WHEN bad THEN o_orderkey END) OVER (PARTITION BY o_custkey) AS first_bad FROM p),
g AS (SELECT *, coalesce(max(CASE WHEN NOT bad THEN reached END) OVER (PARTITION BY o_custkey ORDER BY o_orderkey), 0) AS progress FROM f WHERE first_bad IS NULL OR o_orderkey <= first_bad)
SELECT o_custkey, o_orderkey, stage, progress::DOUBLE AS progress, CASE WHEN bad THEN 'failed' WHEN progress >= 1 THEN 'succeeded' WHEN stage = 'queued' THEN 'queued' ELSE 'running' END AS state FROM g""")
def run_states(t: Tables) -> DataFrame:
    stages = ["questions", "answers", "mapping", "grading", "queued", "done"]
    stage = F.array(*[F.lit(s) for s in stages])[(F.col("o_orderkey") % 6).cast("int")]
    error = F.when(F.col("o_orderkey") % 11 == 0, "broken")
    rows = t.orders.select("o_custkey", "o_orderkey", stage.alias("stage"), error.alias("error"))
    return served.run_states(rows, "o_custkey", ["o_orderkey"]).drop("error")


@query(f"""SELECT l_returnflag AS mapping_type, count(*) AS questions, count(*) FILTER (l_linestatus = 'O') AS hits,
{sql_up("avg(CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END)", 4)} AS accuracy, {sql_up("avg(CASE WHEN l_linenumber = 1 THEN 1 WHEN l_linenumber = 2 THEN 0.5 ELSE 0 END)", 4)} AS mean_iou,
{sql_up("avg(CASE WHEN l_linenumber = 1 THEN 1 ELSE 0 END)", 4)} AS good_iou, {sql_up("avg(CASE WHEN l_linestatus = 'O' THEN 0 ELSE 0.25 END)", 4)} AS mean_cer FROM {LINES} GROUP BY 1""")
def accuracy_by_type(t: Tables) -> DataFrame:
    lines = order_lines(t)
    key = ["l_orderkey", "l_linenumber"]
    right = F.col("l_linestatus") == "O"
    n = F.col("l_linenumber")
    at = F.when(n == 1, 0.0).when(n == 2, 0.0).otherwise(0.6)
    box = G.box(at, F.lit(0.0), F.when(n == 1, 0.5).when(n == 2, 0.25).otherwise(0.8), F.lit(1.0))
    truth = lines.select(*key, F.lit("a").alias("answer_id"), G.box(F.lit(0.0), F.lit(0.0), F.lit(0.5), F.lit(1.0)).alias("bbox"), F.lit("abcd").alias("text"))
    found = lines.select(
        *key, F.col("l_returnflag").alias("mapping_type"), F.when(right, "a").alias("answer_id"), box.alias("bbox"), F.when(right, "abcd").otherwise("abxd").alias("text")
    )
    return served.accuracy_by_type(truth, found, key)


@query(f"""SELECT l_orderkey AS assessment_id, l_linenumber::VARCHAR AS question_id, CASE WHEN l_linenumber = 1 THEN {sql_up("greatest(0, least(l_quantity, 20))")} ELSE 0 END AS score, CASE WHEN l_linenumber = 1 THEN 'llm' ELSE 'deterministic' END AS method
FROM {LINES}""")
def grade_by_assessment(t: Tables) -> DataFrame:
    """A model's grades for the first question of every assessment; ids recur in each of them."""
    lines = order_lines(t)
    ids = [F.col("l_orderkey").alias("assessment_id"), F.col("l_linenumber").cast("string").alias("question_id")]
    questions = lines.select(*ids, F.lit("what is said").alias("text"), F.lit(20.0).alias("max_marks"))
    texts = F.when(F.col("l_linenumber") == 1, "words").otherwise(" ")
    answers = lines.select(F.col("l_orderkey").alias("assessment_id"), F.col("l_linenumber").cast("string").alias("answer_id"), texts.alias("normalized_text"))
    mappings = lines.select(*ids, F.col("l_linenumber").cast("string").alias("answer_id"), F.lit("direct").alias("mapping_type"), F.lit("auto_accepted").alias("review_status"))
    kind = "array<struct<name:string,awarded:double,max_marks:double,rationale:string>>"
    given = lines.filter("l_linenumber = 1").select(*ids, F.col("l_quantity").alias("score"), F.lit("ok").alias("feedback"), F.array().cast(kind).alias("breakdown"))
    return grading.grade(mappings, questions, answers, None, given).select("assessment_id", "question_id", "score", "method")
