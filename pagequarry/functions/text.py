"""Text and key expressions: built-in functions, but for NFKC and the LaTeX table, which go through Arrow."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Unicode white space for Java patterns, whose \s is ASCII.
WS = r"[\s\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]"


SPACES = " \t\n\x0b\f\r\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
#: Marks and the form each gets.
MARKS = ("′’`−–⟶➝", "'''--→→")


@F.pandas_udf(StringType())
def nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


def ascii_lower(c: Column) -> Column:
    """Lower case of A-Z alone: lower() would also change letters of other scripts."""
    return F.translate(c, UPPER, LOWER)


def squeeze(c: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(c, WS + "+", " "))


def plain_marks(c: Column) -> Column:
    """One form of quotes, minus signs and arrows."""
    return F.replace(F.translate(c, *MARKS), F.lit("->"), F.lit("→"))


def prepared(c: Column, normalise: bool = False, drop: str | None = None) -> Column:
    """Text for keyword tests: marks unified, white space squeezed, A-Z lower-cased; NFKC first if asked for; what matches drop becomes a space.

    One translation does all single letters, so the pattern meets only runs of spaces and no lone one.
    """
    c = F.coalesce(c, F.lit(""))
    c = F.translate(nfkc(c) if normalise else c, MARKS[0] + SPACES + UPPER, MARKS[1] + " " * len(SPACES) + LOWER)
    c = F.regexp_replace(F.replace(c, F.lit("->"), F.lit("→")), "  +", " ")
    if drop:
        c = F.regexp_replace(F.regexp_replace(c, drop, " "), "  +", " ")
    return F.trim(c)


def flat(c: Column) -> Column:
    """prepared text without spaces."""
    return F.replace(c, F.lit(" "), F.lit(""))


def keyword_regex(word: str) -> str:
    """Pattern that finds word, its letters perhaps spaced, from the start of a word on."""
    return "(^| )" + " ?".join(re.escape(x) for x in word)


def has_keyword(text: Column, word: str, bare: Column | None = None) -> Column:
    """Of prepared text: a keyword with a space is sought without spaces; another as it stands or spaced from a word's start.

    bare is flat(text), where the caller has it. A spaced keyword stands in it too, so the pattern runs only on texts that it may match.
    """
    bare = flat(text) if bare is None else bare
    if " " in word:
        return F.contains(bare, F.lit(word.replace(" ", "")))
    return F.contains(text, F.lit(word)) | (F.contains(bare, F.lit(word)) & text.rlike(keyword_regex(word)))


def has_token(text: Column, word: str) -> Column:
    """Of prepared text between spaces (see padded): word stands in it as it is, between spaces. A search of bytes, no pattern."""
    return F.contains(text, F.lit(f" {word} "))


def padded(text: Column) -> Column:
    return F.concat(F.lit(" "), text, F.lit(" "))


#: Keywords that hard problems have.
HARD_KEYWORDS = [
    "(가)", "(나)", "(다)", "조건을 만족", "모든 실수", "서로 다른", "최댓값", "최솟값", "개수", "합의 최댓값", "미분가능", "연속", "실수 전체의 집합", "만족시키는", "<보기>", "보기", "ㄱ", "ㄴ", "ㄷ",
    "역함수", "합성함수", "절댓값", "극값", "변곡점", "넓이", "정적분", "수열", "귀납", "확률", "경우의 수", "벡터", "이차곡선",
]


def keyword_count(text: Column, words: list[str] = HARD_KEYWORDS) -> Column:
    """How many of the words occur; one that another holds counts beside it."""
    return sum((F.contains(text, F.lit(w)).cast("int") for w in words), F.lit(0))


def nonspace_len(c: Column) -> Column:
    return F.coalesce(F.length(F.regexp_replace(c, WS + "+", "")), F.lit(0))


def item_key(label: Column, section: Column, number: Column) -> Column:
    """'[label ]section-number'."""
    return F.concat(F.coalesce(F.concat(F.nullif(label, F.lit("")), F.lit(" ")), F.lit("")), section.cast("string"), F.lit("-"), number.cast("string"))


#: Circled digits, black circled digits.
CIRCLED = "①②③④⑤⑥⑦⑧⑨⑩⑪⑫⑬⑭⑮⑯⑰⑱⑲⑳"
DINGBAT = "❶❷❸❹❺❻❼❽❾❿"
#: Label words with numbers of their own, and how lines with numbers begin.
SERIES = ("예제", "유제", "연습문제")
LABEL_NUMBER = r"(?i)^(연습\s*문제|문제|문항|예제|유제|question|q)\s*[:.#-]?\s*0*([0-9]{1,4})(?:\s*[-–]\s*0*([0-9]{1,3}))?(?![0-9])"
ZERO_READ_AS_O = r"^[Oo]([1-9][0-9]{0,2})(?:[.)\]:]|\s)"
ONE_READ_AS_I = r"^[Il][.)\]:](?=\s|[가-힣A-Za-z])"
NUMBER_WORD = r"(?i)^[\[(【<□]?(?:No\.?|#)?0*([0-9]{1,4})[\])】>.]?$"
NUMBER_LINE = r"^[\[(【<□]?0*([0-9]{1,4})(?:[\])】>.:](?=\s|[가-힣A-Za-z({]|$)|(?=\s|$))"
#: Digits of a number as published, and as many as a whole number may have.
DIGITS, ALL_DIGITS = 4, 10


def with_digits(pattern: str, digits: int) -> str:
    """LABEL_NUMBER, ZERO_READ_AS_O, NUMBER_WORD or NUMBER_LINE for numbers of up to so many digits."""
    return pattern.replace("[0-9]{1,4}", f"[0-9]{{1,{digits}}}").replace("[0-9]{0,2}", f"[0-9]{{0,{digits - 2}}}")


QUANTITY = (
    r"^(?:이상|이하|초과|미만|번째|가지|마리|자리|개(?![수념])|배(?![열수])|명(?!제)|번(?!호)|살|권|%|cm|mm|km|kg|mL|[=+×÷*/>≤≥≠]"
    r"|(?:이다|이고|이며|이므로|이면|보다|만큼|씩|와|과|을|를|은|는|가|의|에|로|으로|에서|부터|까지|도|만)(?=$|[\s,.)!?]))"
)
#: How an answer is stated, and points in brackets or at a line's end.
ANSWER = r"(?:정답|해답(?!\s*[0-9]+\s*[.)])|(?<!해)답)\s*[\]】)]?\s*(?:은|는|[:：])?\s*([①②③④⑤]|[-−]?[0-9]{1,4}(?:\.[0-9]+)?(?:\s*/\s*[0-9]{1,4})?)(?![0-9√/^]|\.[0-9])"
POINTS_BOXED = r"[\[(【]\s*([2-4])\s*점\s*[\])】]"
POINTS_FINAL = r"(?m)(?:^|[^0-9.])([2-4])\s*점\s*$"


def _spaced(c: Column) -> Column:
    """All white space but line ends as plain spaces, which Java's \\s knows; null as empty."""
    other = SPACES.replace("\n", "").replace("\r", "")
    return F.translate(F.coalesce(c, F.lit("")), other, " " * len(other))


def circled_number(c: Column) -> Column:
    """Value of a circled digit; null for anything else."""
    at = F.coalesce(F.nullif(F.instr(F.lit(CIRCLED), c), F.lit(0)), F.nullif(F.instr(F.lit(DINGBAT), c), F.lit(0)))
    return F.when(F.length(c) == 1, at)


def extract_answer(text: Column) -> Column:
    """The first stated answer: a circled choice, or a signed whole, decimal or fraction of at most four digits; null if none.

    A head that numbers a solution ('해답 1.') states none, and a value that goes on (2√3, more digits) is no answer.
    """
    got = F.regexp_extract(_spaced(text), ANSWER, 1)
    return F.nullif(F.regexp_replace(F.translate(got, "−", "-"), r"\s+", ""), F.lit(""))


def extract_points(text: Column) -> Column:
    """Points of a problem: 2 to 4 in brackets anywhere, else at a line's end; null if none."""
    t = _spaced(text)
    return F.coalesce(*[F.nullif(F.regexp_extract(t, p, 1), F.lit("")) for p in (POINTS_BOXED, POINTS_FINAL)]).cast("int")


def last_integer(c: Column) -> Column:
    """The last run of digits as a number; null if none."""
    return F.try_element_at(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"(\d+)"), F.lit(1)), F.lit(-1)).try_cast("int")


#: Full-width forms of the printable ASCII letters, and what they are.
_WIDE = "".join(chr(k + 0xFEE0) for k in range(0x21, 0x7F)), "".join(chr(k) for k in range(0x21, 0x7F))


def _compatible(t: Column) -> Column:
    """t with what NFKC would change at a number's place: full-width letters, and a leading number in brackets, with a stop or in a circle over 20."""
    code, rest = F.ascii(t), F.substring(t, 2, 1 << 30)
    number = lambda low, base: (code - low + base).cast("string")
    t = (
        F.when(code.between(0x2474, 0x2487), F.concat(F.lit("("), number(0x2474, 1), F.lit(")"), rest))
        .when(code.between(0x2488, 0x249B), F.concat(number(0x2488, 1), F.lit("."), rest))
        .when(code.between(0x3251, 0x325F), F.concat(number(0x3251, 21), rest))
        .otherwise(t)
    )
    return F.translate(t, _WIDE[0] + "|", _WIDE[1] + "I")


def parse_anchor(line: Column, first_word: Column | None = None, digits: int = DIGITS) -> Column:
    """Struct (num, style, explicit, label, section, quantity, corrected, token) of a line that opens with a number; null for other lines.

    style: circled, label, paren or plain; explicit: how sure the mark is; label: a series with numbers of its own; quantity: what
    follows reads as a count or a formula; corrected: a letter was read as a digit. first_word may be a number that the line's text hides.
    digits: the most that a number has.
    """
    raw = F.trim(_spaced(line))
    return _anchor(raw, _compatible(raw), None if first_word is None else F.trim(_spaced(first_word)), digits)


def with_anchor(df: DataFrame, line: str, out: str, first_word: str | None = None, digits: int = DIGITS) -> DataFrame:
    """df with out: parse_anchor of a line, by way of columns that hold its forms, so that the generated code stays small."""
    word = F.lit(None).cast("string") if first_word is None else F.trim(_spaced(F.col(first_word)))
    x = df.withColumns({"_raw": F.trim(_spaced(F.col(line))), "_word": word}).withColumn("_form", _compatible(F.col("_raw")))
    return x.withColumn(out, _anchor(F.col("_raw"), F.col("_form"), F.col("_word"), digits)).drop("_raw", "_form", "_word")


def _anchor(raw: Column, t: Column, in_word: Column | None, digits: int) -> Column:
    label, zero_as_o, number_word, number_line = (with_digits(p, digits) for p in (LABEL_NUMBER, ZERO_READ_AS_O, NUMBER_WORD, NUMBER_LINE))
    round_ = circled_number(F.substring(raw, 1, 1))
    at = lambda c, p, g: F.nullif(F.regexp_extract(c, p, g), F.lit(""))
    major, minor = at(t, label, 2), at(t, label, 3)
    word = F.regexp_replace(F.regexp_extract(t, label, 1), r"\s+", "")
    null = F.lit(None).cast("string")
    in_word = null if in_word is None else in_word
    token = F.coalesce(at(in_word, number_word, 0), at(t, number_line, 0))
    number = F.when(at(in_word, number_word, 0).isNotNull(), at(in_word, number_word, 1)).otherwise(at(t, number_line, 1))
    marked = token.rlike(r"[\])】>.:]|^[\[(【<□]")
    counts = ~marked & F.ltrim(F.substr(t, F.length(token) + 1)).rlike(QUANTITY)

    def made(num, style, explicit, token, series=null, section=null, quantity=F.lit(False), corrected=False):
        n = num.try_cast("int")
        fields = {"num": n, "style": style, "explicit": explicit, "label": series, "section": section.try_cast("int"), "quantity": F.coalesce(quantity, F.lit(False)), "corrected": F.lit(corrected), "token": token}
        return F.struct(*[c.alias(k) for k, c in fields.items()])

    labelled = major.isNotNull() if digits < ALL_DIGITS else F.coalesce(minor, major).try_cast("int").isNotNull()
    return (
        F.when(round_.isNotNull(), made(round_, F.lit("circled"), F.lit(0.88), F.substring(raw, 1, 1)))
        .when(labelled, made(F.coalesce(minor, major), F.lit("label"), F.lit(1.0), at(t, label, 0), F.when(word.isin(*SERIES), word), F.when(minor.isNotNull(), major)))
        .when(t.rlike(zero_as_o), made(at(t, zero_as_o, 1), F.lit("plain"), F.lit(0.62), at(t, zero_as_o, 0), corrected=True))
        .when(t.rlike(ONE_READ_AS_I), made(F.lit("1"), F.lit("plain"), F.lit(0.58), F.substring(t, 1, 2), corrected=True))
        .when(number.try_cast("int").between(1, 10**digits - 1), made(number, F.when(token.rlike("[()]"), "paren").otherwise("plain"), F.when(marked, 0.78).otherwise(0.48), token, quantity=counts))
    )


def region_label(c: Column) -> Column:
    """Struct (label, section, number) of '[label ][section-]number'."""
    p = rf"^{WS}*(?:({'|'.join(SERIES)}){WS}*)?(?:([0-9]+){WS}*-{WS}*)?([0-9]+){WS}*$"
    part = lambda g: F.nullif(F.regexp_extract(c, p, g), F.lit(""))
    return F.struct(part(1).alias("label"), part(2).try_cast("int").alias("section"), part(3).try_cast("int").alias("number"))


def clean(c: Column, placeholder: str | None = None) -> Column:
    """Trimmed; '' and 'null' are null, and what matches placeholder as a whole (a model's words for 'none')."""
    t = F.regexp_replace(c, rf"^{WS}+|{WS}+$", "")
    some = (t != "") & (F.lower(t) != "null")
    return F.when(some if placeholder is None else some & ~t.rlike(placeholder), t)


def safe_name(c: Column, length: int = 80) -> Column:
    """A file name without reserved characters."""
    return F.substring(F.regexp_replace(F.coalesce(c, F.lit("")), r'[\\/:*?"<>|\x00-\x1f]+', "_"), 1, length)


def subject_particle(word: Column, with_final: str, without_final: str) -> Column:
    """word with the particle that its last Hangul syllable's final consonant asks for."""
    code = F.ascii(F.right(word, F.lit(1)))
    hangul = code.between(0xAC00, 0xD7A3)
    return F.concat(word, F.when(hangul & ((code - 0xAC00) % 28 != 0), F.lit(with_final)).otherwise(F.lit(without_final)))


def hangul_count(c: Column) -> Column:
    return F.length(F.coalesce(c, F.lit(""))) - F.length(F.regexp_replace(F.coalesce(c, F.lit("")), "[가-힣]", ""))


#: LaTeX symbol names and what they print as; other names print as they are.
LATEX_SYMBOLS = {
    "int": "∫", "iint": "∬", "oint": "∮", "sum": "Σ", "prod": "Π", "to": "→", "rightarrow": "→", "infty": "∞", "sqrt": "√", "times": "×", "cdot": "·", "div": "÷", "pm": "±",
    "circ": "∘", "in": "∈", "notin": "∉", "subset": "⊂", "subseteq": "⊆", "supset": "⊃", "supseteq": "⊇", "cup": "∪", "cap": "∩", "emptyset": "∅", "varnothing": "∅",
    "le": "≤", "leq": "≤", "ge": "≥", "geq": "≥", "ne": "≠", "neq": "≠", "pi": "π", "theta": "θ", "alpha": "α", "beta": "β", "angle": "∠", "triangle": "△", "perp": "⊥", "parallel": "∥",
    "overline": "", "vec": "", "left": "", "right": "", "displaystyle": "", "quad": " ", "qquad": " ",
}


@F.pandas_udf(StringType())
def _latex_names(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else re.sub(r"\\([A-Za-z]+)", lambda m: LATEX_SYMBOLS.get(m[1], m[1]), x))


def latex_to_plain(c: Column, rounds: int = 6) -> Column:
    """Text, root and fraction commands from the inside out, then symbol names; braces and dollar signs go."""
    c = F.coalesce(c, F.lit(""))
    for _ in range(rounds):
        c = F.regexp_replace(c, r"\\(?:text|mathrm|operatorname)\s*\{([^{}]*)\}", "$1")
        c = F.regexp_replace(c, r"\\sqrt\s*\{([^{}]*)\}", "√($1)")
        c = F.regexp_replace(c, r"\\[dt]?frac\s*\{([^{}]*)\}\s*\{([^{}]*)\}", "($1)/($2)")
    c = _latex_names(c)
    bare = F.regexp_replace(F.regexp_replace(c, r"\\[,;:! ]", " "), r"[{}$]", "")
    return F.regexp_replace(F.regexp_replace(bare, r"[ \t]+", " "), rf"^{WS}+|{WS}+$", "")


def ai_key(problem_number: Column) -> Column:
    """'letters|last number' of a problem's printed label, Hangul and Latin letters alone; null without a number."""
    n = last_integer(problem_number)
    letters = F.regexp_replace(F.coalesce(problem_number, F.lit("")), "[^가-힣A-Za-z]", "")
    return F.when(n.isNotNull(), F.concat_ws("|", letters, n.cast("string")))
