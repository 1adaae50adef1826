import pytest
from pyspark.sql import functions as F

from pagequarry.functions import jsonfix, stats
from pagequarry.functions import text as tx


def values(spark, rows, expr, ddl="x string"):
    df = spark.createDataFrame([(r,) for r in rows], ddl).coalesce(1)
    return [r[0] for r in df.select(expr(F.col("x"))).collect()]


def test_answers(spark):
    cases = {"정답 −3": "-3", "정답 1 / 2": "1/2", "답 2√3": None, "정답률 45%": None, "해답 1. 풀이 … 따라서 정답 ②": "②", "정답 ④": "④", "답: 12.5": "12.5", "풀이": None, None: None}
    assert values(spark, list(cases), tx.extract_answer) == list(cases.values())


def test_anchors(spark):
    cases = {"2) 값을": (2, "paren"), "O8. OCR": (8, "plain"), "⑳ 마지막": (20, "circled"), "1.5배로 늘리면": None, "예제 3 값": (3, "label")}
    got = values(spark, list(cases), tx.parse_anchor)
    assert [None if g is None else (g["num"], g["style"]) for g in got] == list(cases.values())


def test_points_and_integers(spark):
    assert values(spark, ["넓이는? [4점]", "값은 3점", "13점 만점", None], tx.extract_points) == [4, 3, None, None]
    assert values(spark, ["문제 12-3", "none", None, "7"], tx.last_integer) == [3, None, None, 7]


def test_levels_and_rounding(spark):
    assert values(spark, [1, 2, 3, 4, 5, 6, None], stats.level_to_grade, "x int") == [9, 7, 5, 3, 1, None, None]
    assert values(spark, [-2.5, 2.5, 0.49, -0.5], stats.half_up, "x double") == [-2, 3, 0, 0]


def test_order_statistics(spark):
    rows = [([1.0, 2.0, 3.0, 4.0],), ([],), ([5.0],)]
    df = spark.createDataFrame(rows, "x array<double>").coalesce(1)
    got = df.select(stats.upper_median(F.col("x")), stats.lower_quartile(F.col("x")), stats.quantile_pick(F.col("x"), 0.72)).collect()
    assert [tuple(r) for r in got] == [(3.0, 1.0, 3.0), (0.0, None, None), (5.0, 5.0, 5.0)]


@pytest.mark.parametrize("word,text,hit", [("sin", "a sin b", True), ("ab", "x a b", True), ("ab", "xa b", False), ("a b", "xab", True)])
def test_keywords(spark, word, text, hit):
    df = spark.createDataFrame([(text,)], "x string")
    assert df.select(tx.has_keyword(F.col("x"), word)).first()[0] is hit


def test_latex(spark):
    rows = [r"\frac{1}{2} \times \sqrt{3}", r"\text{값} \le $x$", None]
    assert values(spark, rows, tx.latex_to_plain) == ["(1)/(2) × √(3)", "값 ≤ x", ""]


def test_particles_and_labels(spark):
    assert values(spark, ["책", "노트", "abc"], lambda c: tx.subject_particle(c, "이", "가")) == ["책이", "노트가", "abc가"]
    got = values(spark, ["예제 2-3", "12", "x"], tx.region_label)
    assert [(g["label"], g["section"], g["number"]) for g in got] == [("예제", 2, 3), (None, None, 12), (None, None, None)]


def test_first_object():
    assert jsonfix.first_object('say {"a": "}", "b": {"c": 1}} end') == '{"a": "}", "b": {"c": 1}}'
    assert jsonfix.first_object('cut {"a": 1') == '{"a": 1'
    assert jsonfix.first_object("none") is None


def test_replies(spark):
    rows = [
        '```json\n{"problems": [{"problem_number": "3", "question": "값 \\frac{1}{2}", "choices": "① 1 ② 2", "difficulty_level": "4 (어려움)", "has_figure_or_diagram": "있음"}]}\n```',
        '{"problem_number": "7", "question": "null", "topic": "수열", "difficulty_level": 12}',
        "no json",
        None,
        '{"problems": [{"question": "cut',
    ]
    got = values(spark, rows, jsonfix.problems)
    assert got[0][0]["question"] == r"값 \frac{1}{2}" and got[0][0]["choices"] == ["① 1", "② 2"]
    assert got[0][0]["difficulty_level"] == 4 and got[0][0]["has_figure_or_diagram"]
    assert got[1][0]["question"] is None and got[1][0]["difficulty_level"] is None and got[1][0]["topic"] == "수열"
    assert got[2:] == [None, None, None]


def test_provider_replies(spark):
    df = spark.createDataFrame([("openai", '{"choices":[{"message":{"content":"hi"},"finish_reason":"length"}]}'), ("anthropic", '{"content":[{"text":"a"}],"stop_reason":"end_turn"}')], "p string, b string").coalesce(1)
    got = df.select(jsonfix.reply_text(F.col("p"), F.col("b")), jsonfix.stop_note(F.col("p"), F.col("b"))).collect()
    assert [tuple(r) for r in got] == [("hi", "length"), ("a", None)]


def test_golden_answers(spark):
    cases = {
        "[정답] ③": "③", "【정답】 7": "7", "정답) 5": "5", "정답 12.": "12", "정답 3cm": "3", "정답은 ②": "②", "답: -3": "-3", "해답 ④": "④", "답 12345": None, "답 1.5.2": None, "답 2^3": None, "답 3/4/5": None, "정답 1.25": "1.25", "답 −7": "-7",
        "해답 1) 풀이": None, "해답 2.5": None, "해답 2. 다음 답 9": "9", "정답률 45%": None, "정\n답 3": "3", "정답　⑤": "⑤", "정답 0": "0",
    }
    assert values(spark, list(cases), tx.extract_answer) == list(cases.values())


def test_golden_points(spark):
    cases = {"[4점]": 4, "( 3 점 )": 3, "【2점】": 2, "3 점 .": None, "배점 2.4점": None, "값 3점\n다음": 3, "14점": None, "[5점]": None, "값은 4점  ": 4, "2점 [3점]": 3}
    assert values(spark, list(cases), tx.extract_points) == list(cases.values())


def test_golden_anchors(spark):
    cases = {
        "[3] 값": (3, "plain", 0.78), "１２. 값": (12, "plain", 0.78), "5: 값": (5, "plain", 0.78), "I. 다음": (1, "plain", 0.58), "O8) 다음": (8, "plain", 0.62), "연습 문제 3": (3, "label", 1.0), "문제 12": (12, "label", 1.0),
        "예제 3": (3, "label", 1.0), "□7. 함수": (7, "plain", 0.78), "❺ 문제": (5, "circled", 0.88), "(4) 구하시오": (4, "paren", 0.78), "1.다음": (1, "plain", 0.78), "15 미분": (15, "plain", 0.48), "본문": None, "": None, "0. 영": None,
        "12345": None, "⑶ 다음": (3, "paren", 0.78), "⒌ 값": (5, "plain", 0.78), "007. 첩보": (7, "plain", 0.78), "| . 다음": None, "|. 다음": (1, "plain", 0.58), "1.5배로": None, "　21. 여백": (21, "plain", 0.78),
    }
    got = values(spark, list(cases), tx.parse_anchor)
    assert [None if g is None else (g["num"], g["style"], g["explicit"]) for g in got] == list(cases.values())
    more = values(spark, ["유제 1-2 함수", "question 9", "예제 3", "2 이상의 자연수", "3 개의 점", "12 이다.", "2 + 3 = 5", "3 점 P가", "05 개수를", "05 이 시험에서", "2. 이상"], tx.parse_anchor)
    assert [(g["num"], g["label"], g["section"], g["quantity"]) for g in more] == [
        (2, "유제", 1, False), (9, None, None, False), (3, "예제", None, False), (2, None, None, True), (3, None, None, True), (12, None, None, True), (2, None, None, True), (3, None, None, False), (5, None, None, False), (5, None, None, False), (2, None, None, False),
    ]


def test_first_word_anchors(spark):
    df = spark.createDataFrame([("No.7 다음", "No.7"), ("#3다음", "#3"), ("12다음", "12"), ("본문 3", "본문")], "t string, w string").coalesce(1)
    got = [r[0] for r in df.select(tx.parse_anchor(F.col("t"), F.col("w"))).collect()]
    assert [None if g is None else g["num"] for g in got] == [7, 3, 12, None]


def test_prepared_is_the_pattern_form(spark):
    rows = ["A  b\tC　d", " ’x′ -> −1 ⟶", None, "", "\n\n a \r\n", "Ünïcode ΣΑ", "a - > b", "실수 전체의 집합 R"]
    plain = lambda c: tx.ascii_lower(tx.squeeze(tx.plain_marks(F.coalesce(c, F.lit("")))))
    assert values(spark, rows, tx.prepared) == values(spark, rows, plain)
    assert values(spark, rows[-1:], lambda c: tx.prepared(c, True, "(실수|정수) ?전체의 ?집합")) == ["r"]
    assert values(spark, ["조건을 만족 <보기>", "x", None], lambda c: tx.keyword_count(F.coalesce(c, F.lit("")))) == [3, 0, 0]


def test_levels_of_replies(spark):
    ask = lambda level: '{"problems": [{"question": "q", "difficulty_level": %s}]}' % level
    cases = {'"3단계"': 3, '"4 (어려움)"': 4, '"단계 3"': None, "12": None, '"2.6"': 3, "5": 5, "null": None, '"0"': None}
    assert [r[0]["difficulty_level"] for r in values(spark, [ask(k) for k in cases], jsonfix.problems)] == list(cases.values())
    assert values(spark, ['{"problems": [{"question": "q", "passage": "공통 지문이 있는 경우 여기에 작성, 없으면 null", "choices": ["① a", " ", null]}]}'], jsonfix.problems)[0][0]["choices"] == ["① a"]


def test_subjects_and_units(spark):
    cases = {"수학 II - 미분계수와 도함수": "수학II", "수학Ⅰ 수열": "수학I", "수학 1": "수학I", "미적분 2: 급수": "미적분II", "공통수학 II": "공통수학2", "미적분 - 적분": "미적분", "물리": None, None: None, "확률과 통계 | 순열": "확률과 통계"}
    assert values(spark, list(cases), jsonfix.subject_of) == list(cases.values())
    assert values(spark, ["수학 II - 미분계수", "수열", "", None, "a | b : c"], jsonfix.unit_of) == ["미분계수", "수열", "", "", "c"]
