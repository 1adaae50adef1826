import json

from pyspark.sql import functions as F

from pagequarry.functions import jsonfix
from pagequarry.functions import text as tx
from pagequarry.operators import flow, grade, link, review

FRAGMENT = "struct<page:int,x0:double,y0:double,x1:double,y1:double,cont:boolean>"
ITEM = (
    f"id string, book_id string, kind string, label string, section int, number int, inferred boolean, ocr_number int, number_manual boolean, fragments array<{FRAGMENT}>, page_height int, h int, "
    "text string, points int, answer string, answer_manual boolean, answer_llm boolean, solution_id string, solution_inferred boolean, grade_manual int, grade_llm int, difficulty_llm int, unit string, "
    f"subject_llm string, llm_reason string, type_llm string, type_manual string, ai_problems array<struct<{jsonfix.PROBLEM}>>, ai_stale boolean"
)
NAMES = ("id book_id kind label section number inferred ocr_number number_manual fragments page_height h text points answer answer_manual answer_llm solution_id solution_inferred "
         "grade_manual grade_llm difficulty_llm unit subject_llm llm_reason type_llm type_manual ai_problems ai_stale").split()  # fmt: skip


def items(spark, *rows):
    return spark.createDataFrame([tuple(r.get(n) for n in NAMES) for r in rows], ITEM)


def item(ident, kind, number, book="b", section=1, **k):
    return {"id": ident, "book_id": book, "kind": kind, "section": section, "number": number, "inferred": False} | k


def at(page, y, x=0.0, cont=False):
    return [(page, x, y, x + 100, y + 50, cont)]


def test_relink(spark):
    df = items(
        spark,
        item("p1", "problem", 1), item("p2", "problem", 2, answer="mine", answer_manual=True), item("p3", "problem", 3, inferred=True), item("p4", "problem", 9, ocr_number=4, inferred=True), item("p5", "problem", 50),
        item("s1", "solution", 1, answer="①"), item("s2", "solution", 2, answer="②"), item("s3", "solution", 3, answer="③"), item("s4", "solution", 4, answer="④"),
        item("q1", "problem", 7, "c", label="유제"), item("t1", "solution", 7, "c", label="예제"), item("t2", "solution", 7, "c", section=4, label="유제", answer="⑤"),
    )
    done = flow.relink(df)
    got = {r.id: (r.solution_id, r.solution_inferred, r.answer) for r in done.where("kind = 'problem'").collect()}
    assert got == {"p1": ("s1", False, "①"), "p2": ("s2", False, "mine"), "p3": ("s3", True, None), "p4": ("s4", True, None), "p5": (None, False, None), "q1": ("t2", False, "⑤")}
    assert done.count() == df.count()
    stats = {r.book_id: (r.problems, r.solutions, r.matched, r.inferred_links) for r in flow.link_stats(done).collect()}
    assert stats == {"b": (5, 4, 4, 2), "c": (1, 2, 1, 0)}
    assert flow.relink(df.limit(0)).count() == 0


def test_short_key_counts_inferred_problems(spark):
    p = spark.createDataFrame([("p1", 1, 5, False), ("p2", 2, 5, True)], "problem_id string, section int, number int, inferred boolean")
    s = spark.createDataFrame([("s1", 3, 5)], "solution_id string, section int, number int")
    assert link.match_by_key(p, s, [], ["section", "number"], ["number"]).count() == 0


def test_finalise(spark):
    df = items(spark, item("p1", "problem", 1, fragments=at(1, 0.0)), item("s1", "solution", 1, fragments=at(2, 0.0)), item("p2", "problem", 2, fragments=at(9, 0.0)))
    lines = spark.createDataFrame(
        [("b", "problem", 1, 0, "값은? [4점]", 0.0, 5.0, 90.0, 10.0), ("b", "problem", 1, 1, "out", 0.0, 90.0, 90.0, 99.0), ("b", "solution", 2, 0, "정답 ③", 0.0, 5.0, 90.0, 10.0)],
        "book_id string, kind string, page int, seq int, text string, x0 double, y0 double, x1 double, y1 double",
    )
    pages = spark.createDataFrame([("b", "problem", 1, 800), ("b", "solution", 2, 900)], "book_id string, kind string, page int, height int")
    got = {r.id: (r.text, r.page_height, r.points, r.answer) for r in flow.finalise(df, lines, pages).collect()}
    assert got == {"p1": ("값은? [4점]", 800, 4, None), "s1": ("정답 ③", 900, None, "③"), "p2": ("", 1, None, None)}


def test_grade_books_uses_the_level(spark):
    books = spark.createDataFrame([("b", "killer"), ("c", "nonsense")], "id string, level string")
    df = items(spark, *[item(f"p{k}", "problem", k, h=10 * k, page_height=100, text="x" * k) for k in range(1, 6)], *[item(f"q{k}", "problem", k, "c", h=10 * k, page_height=100, text="x" * k) for k in range(1, 10)])
    got = {r.id: r.grade_heur for r in flow.grade_books(df, books, ["그래프"]).collect()}
    assert [got[f"p{k}"] for k in range(1, 6)] == [3, 3, 2, 2, 1] and [got[f"q{k}"] for k in range(1, 10)] == [9, 8, 7, 6, 5, 4, 3, 2, 1]


def test_features(spark):
    df = spark.createDataFrame([(1, 1, None), (3, 5, "s")], "n int, last int, sol string").coalesce(1)
    c, none = F.col, F.lit(None).cast("int")
    f = grade.features(c("n"), c("last"), none, none, F.lit(None).cast("string"), F.lit(0), none, c("sol"), none, none, F.lit(None).cast("string"))
    assert [tuple(r) for r in df.select(*f.values()).collect()] == [(0.5, 0.0, 0.0, 0.0, None, None), (0.5, 0.0, 0.0, 0.0, None, 0.0)]


def test_classify_and_pool(spark):
    rules = [(0, "수열", "word", "등차수열", 3.0), (1, "확률", "word", "확률", 3.0)]
    df = items(spark, item("a", "problem", 1, text="등차수열의 합"), item("b", "problem", 2, text="다음을"), item("c", "problem", 3, text="등차수열"), item("d", "problem", 4, text="확률", type_manual="기하"), item("e", "problem", 1, "x", text="없음", subject_llm=""))
    typed = flow.classify_items(df, rules)
    assert {r.id: (r.type, r.type_source) for r in typed.collect()} == {"a": ("수열", "rule"), "b": ("수열", "neighbor"), "c": ("수열", "rule"), "d": ("기하", "manual"), "e": ("미분류", "none")}
    books = spark.createDataFrame([("b", "수학I"), ("z", None)], "id string, subject string")
    assert {(r.id, r.subject) for r in flow.load_pool(typed, books).collect()} == {(k, "수학I") for k in "abcd"}
    assert flow.load_pool(typed, books.withColumn("id", F.lit("x")).limit(1).withColumn("subject", F.lit(""))).first().subject == "(미정)"


def test_resegment(spark):
    old = items(
        spark, item("o1", "problem", 1, fragments=at(1, 0.0), grade_manual=2, ai_problems=[], ai_stale=False), item("o2", "problem", 7, fragments=at(1, 200.0), number_manual=True, answer="3", answer_manual=True, ai_problems=[]),
        *[item(f"k{n}", "problem", n, "keep", fragments=at(n, 0.0)) for n in range(8)],
    )
    new = items(spark, item("n1", "problem", 1, fragments=at(1, 2.0), page_height=1000), item("n2", "problem", 2, fragments=at(1, 210.0), page_height=1000, ocr_number=5, inferred=True), item("n3", "problem", 3, fragments=at(4, 0.0)), item("m1", "problem", 1, "keep", fragments=at(1, 0.0)))
    got = {r.id: r for r in flow.resegment(old, new).collect()}
    assert set(got) == {"n1", "n2", "n3", *(f"k{n}" for n in range(8))}  # one of eight is too few
    assert got["n1"].grade_manual == 2 and got["n1"].ai_stale is False
    assert (got["n2"].number, got["n2"].inferred, got["n2"].ocr_number, got["n2"].answer, got["n2"].ai_stale) == (7, False, None, "3", True)
    assert got["n3"].grade_manual is None and got["n3"].ai_problems is None


def test_flags_and_export(spark):
    ok, bad = ("3", None, "값은?", ["①"], False, None, 3, None), ("예제 12", None, None, ["[미상]"], None, "수열", None, "r")
    df = spark.createDataFrame([(1, [ok], 0, 3, None), (2, [ok, bad], 1, 3, True), (3, None, None, 3, None), (4, [], 5, 3, True)], f"id int, ps array<struct<{jsonfix.PROBLEM}>>, main int, number int, stale boolean").coalesce(1)
    c = F.col
    rows = df.select(review.review_flags(c("ps"), c("main"), c("number"), c("stale")).alias("f"), review.needs_analysis(c("ps"), c("stale"), F.lit(3)).alias("n"), review.schema_json(c("ps")).alias("j")).collect()
    assert [r.f for r in rows] == [[], ["several", "unreadable", "number", "stale"], [], []] and [r.n for r in rows] == [False, True, True, True]
    out = json.loads(rows[1].j)["problems"][1]
    assert list(out) == ["problem_number", "passage", "question", "choices", "has_figure_or_diagram", "topic", "difficulty_level", "difficulty_reasoning"]
    assert out["question"] == "" and out["has_figure_or_diagram"] is False and out["passage"] is None


def test_pending_kinds(spark):
    df = spark.createDataFrame([(3, 2, None, None, True, "error"), (3, 2, True, None, True, "complete"), (3, 2, None, None, False, None), (0, 0, None, None, True, None)], "p int, s int, dp boolean, ds boolean, recorded boolean, status string").coalesce(1)
    c = F.col
    kinds = review.pending_kinds({"problem": c("p"), "solution": c("s")}, {"problem": c("dp"), "solution": c("ds")}, {"problem": F.lit(0), "solution": F.lit(0)}, c("recorded"), c("status"))
    assert [r.k for r in df.select(kinds.alias("k")).collect()] == [["problem", "solution"], ["solution"], [], []]
    assert [r.t for r in df.select(review.todo_notice(kinds, " 남음").alias("t")).collect()] == ["문제집·해설지는 남음", "해설지는 남음", "", ""]


def test_missing_pages_and_quality(spark):
    df = items(spark, item("a", "problem", 1, fragments=at(1, 0.0) + at(3, 0.0) + at(2, 0.0)), item("b", "problem", 2, fragments=at(1, 0.0), inferred=True))
    pages = spark.createDataFrame([("b", "problem", 1, "x", 4), ("b", "problem", 2, None, 0)], "book_id string, kind string, page int, image string, lexical_candidates int")
    assert [(r.id, r.pages) for r in review.pages_without_image(df, pages, ["book_id", "kind"]).collect()] == [("a", [2, 3])]
    assert tuple(review.review_quality(df, pages, ["book_id", "kind"]).first()) == ("b", "problem", 2, 1, 2, 1)


def test_problem_blocks(spark):
    blocks = {
        "asks": ["수열의 합을 구하면", "그 값은?", "(단, a>0)"], "request": ["값을 구하시오."], "concept": ["등차수열은 다음과 같다", "무엇이 될까?"], "choices": ["다음 설명", "① 1 ② 2"],
        "column": ["개념 설명이다", "① 1", "② 2", "③ 3"], "list": ["개념 설명이다", "① 이것은 아주 긴 설명의 첫째 줄이라서 선택지가 아니다", "② 1"], "points": ["함수 [ 4 점 ]"], "middle": ["값은? (참고)", "개념을 정리한다"],
    }
    df = spark.createDataFrame([(b, k, t) for b, ts in blocks.items() for k, t in enumerate(ts)], "b string, k int, text string")
    got = {r.b for r in review.problem_blocks(df, ["b"], "k").where("is_problem").collect()}
    assert got == {"asks", "request", "choices", "column", "points"}


def test_latex_of_the_classifier(spark):
    df = spark.createDataFrame([(r"\sum_{k=1}^{n} \tfrac{1}{k}",), (r"\sin x \circ \overline{AB}",)], "t string").coalesce(1)
    assert [r[0] for r in df.select(tx.latex_to_plain(F.col("t"))).collect()] == ["Σ_k=1^n (1)/(k)", "sin x ∘ AB"]
    df = spark.createDataFrame([("예제 12.",), ("12",), ("x",)], "t string").coalesce(1)
    assert [r[0] for r in df.select(tx.ai_key(F.col("t"))).collect()] == ["예제|12", "|12", None]
