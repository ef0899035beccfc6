"""Work of queries over copies of their tables: what one task or one Python process gets must not grow with them."""

import re
import unicodedata

import pytest
from pagewright.functions import text as T
from pagewright.operators import library as L
from pagewright.operators import mapping, queue
from pagewright.queries import QUERIES
from pyspark.sql import functions as F


@pytest.mark.parametrize("form", ["NFC", "NFKC", "NFD", "NFKD"])
def test_only_texts_that_a_normal_form_alters_go_to_python(spark, form):
    odd = ["", None, "plain", "déjà vu ß", "ét", "ẛ̣", "ﬁn", "½ µ ª", " ", "가", "가", "Ǆ", "漢字ｶﾞ", "á̧", "\U0001d15e", "क़"]
    texts = odd + [chr(i) + chr(j) for i in range(0, 0x300, 7) for j in (0x41, 0xE9, 0x17F, 0x301)] + [chr(i) for i in range(0x300)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r.i: r.n for r in df.select("i", T.normal_form(form)(F.col("t")).alias("n")).collect()}
    assert got == {i: None if t is None else unicodedata.normalize(form, t) for i, t in enumerate(texts)}
    if form == "NFC":
        plan = df.select(T.normal_form(form)(F.col("t")).alias("n"))._jdf.queryExecution().optimizedPlan().toString()
        assert "NOT RLIKE(" in plan  # accents alone do not send a text there


def test_copies_of_a_title_are_tried_once(spark):
    key_of = lambda t, a: F.concat(F.lower(t), F.lit("|"), F.coalesce(a, F.lit("")))
    held = spark.createDataFrame([("a|", "A"), ("a (copy)|", "x"), ("b|ann", "B")], "key string, title string")
    asked = spark.range(2000).selectExpr("id AS seq", "if(id % 2 = 0, 'A', 'B') AS title", "if(id % 2 = 0, null, 'ann') AS author", "'new' AS resolution")
    made = L.creations(asked, held, key_of)
    rows = made.collect()
    assert len(rows) == 2000 and {(r.title, r.project) for r in rows} == {("A", "a (copy) (copy)|"), ("B", "b (copy)|ann")}
    lines = made._jdf.queryExecution().optimizedPlan().toString().split("\n")
    tried = next(i for i, x in enumerate(lines) if "Generate explode" in x)
    assert any("Aggregate [title" in x for x in lines[tried:])


def test_requests_for_unknown_slots_are_spread(spark):
    asked = spark.range(4000).selectExpr("id AS seq", "'restore' AS action", "concat('no-', id) AS slot")
    trashed = spark.createDataFrame([("a", "a-1"), ("b", "b-1")], "slug string, slot string")
    answers = queue.trash_requests(asked, trashed, trashed.select("slug").limit(0), "slug")
    assert {(r.answer, r["count"]) for r in answers.groupBy("answer").count().collect()} == {("not found", 4000)}
    plan = answers._jdf.queryExecution().optimizedPlan().toString()
    assert re.search(r"windowspecdefinition\(slug#\d+, ", plan) and not re.search(r"windowspecdefinition\(slug#\d+, seq", plan)


def test_health_counts_are_by_shelf_and_over_all(spark):
    rows = QUERIES["a17_health_counts"](spark, "/root/testdata/sf0.001").collect()
    shelves = {(r.segment, r["class"]): r.n for r in rows if not r.all_segments}
    every = {r["class"]: (r.n, r.last_activity) for r in rows if r.all_segments}
    assert len({s for s, _ in shelves}) > 1 and sum(shelves.values()) == sum(n for n, _ in every.values())
    for c, (n, last) in every.items():
        assert n == sum(v for (_, k), v in shelves.items() if k == c)
        assert last == max((r.last_activity for r in rows if r["class"] == c and not r.all_segments and r.last_activity), default=None)


def test_a_plan_that_serves_several_kinds_is_made_once_and_apart(spark):
    kinds = spark.createDataFrame([(1, True, False), (2, False, True), (3, False, False)], "book int, a boolean, b boolean")
    steps = spark.createDataFrame([(1, 10), (1, 11), (2, 20), (3, 30)], "book int, step int")
    chosen = mapping.chosen_plan(kinds, {"a": steps, "b": steps}, "book")
    assert sorted((r.book, r.step, r.kind) for r in chosen.collect()) == [(1, 10, "a"), (1, 11, "a"), (2, 20, "b")]
    plan = chosen._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RepartitionByExpression") == 1
    counted = QUERIES["p7_preview"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert counted.count("REPARTITION_BY_COL") >= 4  # parts of a plan end in a shuffle that Spark does not leave out
