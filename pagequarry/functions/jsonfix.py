"""Model replies: the first object in a text, repaired LaTeX escapes, and a fixed problem schema."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .stats import half_up, level_to_grade
from .text import CIRCLED, clean, latex_to_plain

PROBLEM = (
    "problem_number string, passage string, question string, choices array<string>, has_figure_or_diagram boolean, topic string, difficulty_level int, difficulty_reasoning string"
)
#: Fixed value: the example in the prompt that models copy where there is no passage.
PLACEHOLDER = "^공통 지문이 있는 경우 여기에 작성, 없으면 null$"
#: Words that open with a JSON escape's letter but are LaTeX.
LATEX_WORDS = ("beta", "bar", "begin", "big", "binom", "bot", "boxed", "frac", "forall", "nabla", "ne", "neq", "neg", "not", "nu", "notin", "rho", "right", "rightarrow", "rangle", "text", "theta", "times", "to", "triangle", "tan", "tau")


def first_object(text: str) -> str | None:
    """From the first brace to its match, strings and escapes regarded; a cut-off text to its end; None without a brace."""
    start = text.find("{")
    if start < 0:
        return None
    depth, quoted, i = 0, False, start
    while i < len(text):
        c = text[i]
        if quoted:
            if c == "\\":
                i += 1
            elif c == '"':
                quoted = False
        elif c == '"':
            quoted = True
        elif c == "{":
            depth += 1
        elif c == "}":
            depth -= 1
            if not depth:
                return text[start : i + 1]
        i += 1
    return text[start:]


_LITERAL = re.compile(r'"((?:[^"\\]|\\.)*)"', re.S)
_ESCAPE = re.compile(r"\\(u[0-9a-fA-F]{4}|[A-Za-z]+|.)", re.S)


def _escape(m: re.Match) -> str:
    body = m[1]
    if body[0] == "u" and len(body) == 5 or body in ('"', "\\", "/"):
        return m[0]
    if body.isalpha():
        if body in LATEX_WORDS or body[0] not in "bfnrtu" or body[0] == "u":
            return "\\\\" + body
        return m[0]
    return "\\\\" + body


def repair(text: str) -> str:
    """JSON whose string literals hold single backslashes of LaTeX or raw line breaks, made valid."""

    def literal(m: re.Match) -> str:
        s = _ESCAPE.sub(_escape, m[1])
        return '"' + s.replace("\r\n", "\\n").replace("\n", "\\n").replace("\r", "\\n").replace("\t", "\\t") + '"'

    return _LITERAL.sub(literal, text)


def row_breaks(s: str) -> str:
    """Matrix and case rows whose double backslash became one get it back."""
    return re.sub(r"(\\begin\{(?:p|b|v|V|B)?(?:matrix|cases|array|aligned)\})(.*?)(\\end\{)", lambda m: m[1] + re.sub(r"(?<!\\)\\(?=\s)", r"\\\\", m[2]) + m[3], s, flags=re.S)


def map_strings(v, fn):
    if isinstance(v, str):
        return fn(v)
    if isinstance(v, list):
        return [map_strings(x, fn) for x in v]
    if isinstance(v, dict):
        return {k: map_strings(x, fn) for k, x in v.items()}
    return v


def parse_reply(text: str | None) -> str | None:
    """A reply as a JSON array of problem objects; None if there is none."""
    if not text:
        return None
    bracket, brace = text.find("["), text.find("{")
    raw = first_object(text)
    if raw is None:
        return None
    tries = [repair(raw), raw]
    if 0 <= bracket < brace and (end := text.rfind("]")) > brace:
        tries = [repair(text[bracket : end + 1]), text[bracket : end + 1], *tries]
    for t in tries:
        try:
            v = json.loads(t)
        except ValueError:
            continue
        v = map_strings(v, row_breaks)
        if isinstance(v, dict):
            v = v.get("problems", v)
        found = [p for p in (v if isinstance(v, list) else [v]) if isinstance(p, dict) and any(p.get(k) for k in ("question", "passage", "problem_number", "topic"))]
        return json.dumps(found, ensure_ascii=False) if found else None
    return None


@F.pandas_udf(StringType())
def reply_json(s: pd.Series) -> pd.Series:
    return s.map(parse_reply)


def normalise_problem(p: Column) -> Column:
    """A string-typed problem struct as the fixed schema: choices split at circled digits, level from the number it begins with, rounded, flag from its words."""
    level = half_up(F.nullif(F.regexp_extract(F.coalesce(p["difficulty_level"], F.lit("")), r"^\s*([0-9]+(?:\.[0-9]+)?)(?![0-9])", 1), F.lit("")).try_cast("double")).cast("int")
    listed = F.filter(F.transform(F.from_json(p["choices"], "array<string>"), lambda c: clean(c)), lambda c: c.isNotNull())
    split = F.filter(F.transform(F.split(p["choices"], f"(?=[{CIRCLED}])"), lambda c: clean(c)), lambda c: c.isNotNull())
    return F.struct(
        clean(p["problem_number"]).alias("problem_number"),
        clean(p["passage"], PLACEHOLDER).alias("passage"),
        clean(p["question"]).alias("question"),
        F.coalesce(listed, split, F.array().cast("array<string>")).alias("choices"),
        F.lower(F.trim(F.coalesce(p["has_figure_or_diagram"], F.lit("")))).isin("true", "yes", "있음").alias("has_figure_or_diagram"),
        clean(p["topic"]).alias("topic"),
        F.when(level.between(1, 5), level).alias("difficulty_level"),
        clean(p["difficulty_reasoning"]).alias("difficulty_reasoning"),
    )


def problems(raw: Column) -> Column:
    """Array of problems of a reply; null if it holds none."""
    strings = "array<struct<problem_number string, passage string, question string, choices string, has_figure_or_diagram string, topic string, difficulty_level string, difficulty_reasoning string>>"
    return F.transform(F.from_json(reply_json(raw), strings.replace(" string", ": string")), normalise_problem)


def primary_index(found: Column, number: Column) -> Column:
    """Place (from 0) of the first problem whose printed number is number, else 0."""
    numbers = F.transform(found, lambda p: F.try_element_at(F.regexp_extract_all(F.coalesce(p["problem_number"], F.lit("")), F.lit(r"(\d+)"), F.lit(1)), F.lit(-1)).try_cast("int"))
    return F.greatest(F.coalesce(F.array_position(numbers, number), F.lit(0)) - 1, F.lit(0)).cast("int")


def summarise(df: DataFrame, found: str, number: str) -> DataFrame:
    """df with the primary problem's level, grade, topic, subject (of the topic's text) and reason; types_from_analysis gives its type."""
    x = df.withColumn("primary", primary_index(F.col(found), F.col(number)))
    p = F.get(F.col(found), F.col("primary"))
    return x.withColumns({"difficulty": p["difficulty_level"], "grade_llm": level_to_grade(p["difficulty_level"]), "topic": p["topic"], "subject_llm": subject_of(p["topic"]), "llm_reason": p["difficulty_reasoning"]})


#: Subjects that a topic's text may begin with.
SUBJECTS = ("공통수학1", "공통수학2", "대수", "미적분I", "미적분II", "수학(상)", "수학(하)", "수학I", "수학II", "미적분", "확률과 통계", "기하")


def subject_form(c: Column) -> Column:
    """A subject's name without spaces and brackets; 1 and 2 as I and II behind 수학 and 미적분, the other way round behind 공통수학."""
    roman = F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("Ⅱ"), F.lit("II")), F.lit("Ⅰ"), F.lit("I"))
    t = F.regexp_replace(roman, r"[\s()（）]", "")
    t = F.regexp_replace(F.regexp_replace(t, "^(수학|미적분)1(?![0-9])", "$1I"), "^(수학|미적분)2(?![0-9])", "$1II")
    return F.regexp_replace(F.regexp_replace(t, "^공통수학II(?![A-Za-z])", "공통수학2"), "^공통수학I(?![A-Za-z])", "공통수학1")


def subject_of(topic: Column, subjects: tuple[str, ...] = SUBJECTS) -> Column:
    """The subject that a topic's text begins with, the longest of several; null if none."""
    t = subject_form(topic)
    hits = F.array(*[F.when(F.startswith(t, subject_form(F.lit(s))), F.struct(F.length(subject_form(F.lit(s))).alias("n"), F.lit(s).alias("name"))) for s in subjects])
    return F.array_max(F.filter(hits, lambda x: x.isNotNull()))["name"]


def unit_of(topic: Column) -> Column:
    """The last part of a topic's text, behind dashes, colons or bars."""
    return F.coalesce(F.try_element_at(F.filter(F.split(F.coalesce(topic, F.lit("")), r"\s*[-–—:>|]\s*"), lambda x: x != ""), F.lit(-1)), F.lit(""))


def body_of(problem: Column) -> Column:
    """A problem's passage, question and choices as plain text, for rules."""
    parts = F.concat(F.array(problem["passage"], problem["question"]), F.coalesce(problem["choices"], F.array().cast("array<string>")))
    return latex_to_plain(F.array_join(F.filter(parts, lambda x: x.isNotNull() & (x != "")), "\n"))


def types_from_analysis(df: DataFrame, problem: str, subject: str, out: str = "type_llm", **how) -> DataFrame:
    """df with out: the type that a problem's unit names, else its whole topic, else its text (how: as of operators.classify.normalise_types)."""
    from ..operators.classify import normalise_types

    p = F.col(problem)
    x = df.withColumns({"_unit": unit_of(p["topic"]), "_topic": F.coalesce(p["topic"], F.lit("")), "_body": body_of(p)})
    for c in ("_unit", "_topic", "_body"):
        x = normalise_types(x, c, subject, out=f"{c}_type", **how)
    found = F.coalesce("_unit_type", "_topic_type", "_body_type")
    return x.select(*[c for c in df.columns if c != out], found.alias(out))


def reply_text(provider: Column, body: Column) -> Column:
    """A provider's reply text out of its response body."""
    path = lambda p: F.get_json_object(body, p)
    parts = lambda p: F.array_join(F.from_json(path(p), "array<string>"), "")
    return (
        F.when(provider == "gemini", F.coalesce(parts("$.candidates[0].content.parts[*].text"), path("$.candidates[0].content.parts[0].text")))
        .when(provider == "anthropic", F.coalesce(parts("$.content[*].text"), path("$.content[0].text")))
        .when(provider == "openai", path("$.choices[0].message.content"))
        .when(provider == "ollama", path("$.message.content"))
    )


def stop_note(provider: Column, body: Column) -> Column:
    """An abnormal stop reason; null for a normal end."""
    why = F.coalesce(*[F.get_json_object(body, p) for p in ("$.candidates[0].finishReason", "$.stop_reason", "$.choices[0].finish_reason", "$.done_reason")])
    return F.when(~F.lower(why).isin("stop", "end_turn", "stop_sequence"), why)
