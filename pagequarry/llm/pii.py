"""Personal data, in DataFrame operations only.

Regular expressions propose spans, validators (Luhn, mod-97, number ranges, digit counts) confirm them, and context
words near a span raise its score; spans of BASE kinds stay whatever their score (the score says how sure they are), those of other
kinds from LEAST on. redact follows the same rule: kinds that need context come first, on the text as it was.
Positions come from the gaps that splitting by a pattern leaves. The patterns start only where a run of their first
class starts (or the last match ended), so a long run costs one attempt and not one for each character.

Defined results: null and empty texts have no spans; all spans count code points; a very long text is searched whole; spans of
two kinds may overlap and both stay (redact replaces the kinds in KINDS' order, those that need context first); repeated rows
each get theirs; null ids pass through; an empty table gives no rows; extra columns are ignored by find and kept by redact.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEAST = 0.6
#: Code points on either side of a span where context words count, and what they add.
NEAR, CONTEXT = 48, 0.25
BASE = ("email", "ip", "card", "phone")

_DIGITS = "regexp_replace(m, '[^0-9]', '')"
_LUHN = f"aggregate(transform(sequence(1, length({_DIGITS})), i -> transform(array(cast(substr({_DIGITS}, -i, 1) as int) * (2 - i % 2)), v -> v div 10 + v % 10)[0]), 0L, (a, v) -> a + v) % 10 = 0"
_IBAN = "regexp_replace(m, ' ', '')"
#: Remainder by 97 of the rearranged number, letters as 10 to 35.
_MOD97 = (
    f"aggregate(split(concat(substr({_IBAN}, 5), substr({_IBAN}, 1, 4)), ''), 0, (a, c) -> if(c = '', a, if(c between '0' and '9', (a * 10 + ascii(c) - 48) % 97, (a * 100 + ascii(c) - 55) % 97))) = 1"
)

#: kind: pattern, cheap test that a text with a match passes, validator of m, score, context words
KINDS: dict[str, tuple[str, str, str, float, str]] = {
    "email": (r"(?:(?<![A-Za-z0-9._%+-])|\\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\\.[A-Za-z0-9-]++)++", "contains(t, '@')", "true", 0.8, "mail|contact|write|kontakt"),
    "ip": (
        r"(?:(?<![0-9])|\\G)[0-9]++(?:\\.[0-9]++){3}",
        r"t rlike '[0-9]\\.[0-9]++\\.[0-9]++\\.[0-9]'",
        r"forall(split(m, '\\.'), p -> length(trim(LEADING '0' FROM p)) <= 3 and cast(concat('0', trim(LEADING '0' FROM p)) as int) <= 255)",
        0.7,
        "ip|host|server|address|login",
    ),
    "card": (r"[0-9](?:[\\x20-]?[0-9])++", r"t rlike '[0-9](?:[\\x20-]?[0-9]){15}'", f"length({_DIGITS}) between 16 and 19 and {_LUHN}", 0.8, "card|visa|credit|payment|karte|carte|tarjeta"),
    "phone": (r"\\+[0-9][\\x20().0-9-]+[0-9]", r"t rlike '\\+[0-9]'", f"length({_DIGITS}) between 8 and 15", 0.7, "phone|call|tel|mobile|fax"),
    "iban": (
        r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\\x20?[A-Z0-9]{4}){2,7}(?:\\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
        r"t rlike '[A-Z]{2}[0-9]{2}\\x20?[A-Z0-9]{4}'",
        f"length({_IBAN}) between 15 and 34 and {_MOD97}",
        0.8,
        "iban|account|bank|konto|compte|cuenta",
    ),
    "ssn": (r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", r"t rlike '[0-9]{3}-[0-9]{2}-[0-9]{4}'", "substr(m, 1, 3) not in ('000', '666') and substr(m, 1, 1) <> '9' and substr(m, 5, 2) <> '00' and substr(m, 8) <> '0000'", 0.4, "ssn|social security|tax id"),
    "secret": (r"(?<![A-Z0-9])AKIA[0-9A-Z]{16}(?![A-Z0-9])|(?<![A-Za-z])(?:password|passwd|secret|api_key)=[^\\x20\\x09-\\x0D]{8,}+", r"t rlike 'AKIA|(?:password|passwd|secret|api_key)='", "true", 0.8, "key|secret|token|password"),
}

_CHUNK = 256


def _proposed(kind: str) -> str:
    """Array of (s, e, m) of a pattern's matches in t: prefix sums of gap and match lengths, in chunks so that no fold grows long."""
    pattern, test, *_ = KINDS[kind]
    lens = f"zip_with(slice(split(t, '{pattern}', -1), 1, size(regexp_extract_all(t, '{pattern}', 0))), regexp_extract_all(t, '{pattern}', 0), (a, b) -> struct(length(a) as a, length(b) as b, b as m))"
    none = "cast(array() as array<struct<s:int,e:int,m:string>>)"
    chunks = f"transform(sequence(0, (size(l) - 1) div {_CHUNK}), c -> slice(l, c * {_CHUNK} + 1, {_CHUNK}))"
    local = f"transform({chunks}, x -> aggregate(x, struct(0 as at, {none} as o), (q, y) -> struct(q.at + y.a + y.b as at, concat(q.o, array(struct(q.at + y.a as s, q.at + y.a + y.b as e, y.m as m))) as o)))"
    base = "aggregate(r, struct(0 as at, cast(array() as array<int>) as o), (q, y) -> struct(q.at + y.at as at, concat(q.o, array(q.at)) as o)).o"
    shifted = f"transform(array({local}), r -> flatten(zip_with(r, {base}, (y, b) -> transform(y.o, z -> struct(z.s + b as s, z.e + b as e, z.m as m)))))[0]"
    return f"if({test}, transform(array({lens}), l -> if(size(l) = 0, {none}, {shifted}))[0], {none})"


def _near(kind: str, start: str, end: str) -> str:
    """A context word of the kind stands within NEAR code points of a span of t."""
    return f"substr(t, greatest(1, {start} + 1 - {NEAR}), {end} - {start} + 2 * {NEAR}) rlike '(?i)(?<![a-z])(?:{KINDS[kind][4]})'"


def _spans(kind: str) -> str:
    """The kind's spans of t, with scores."""
    score = KINDS[kind][3]
    valid = f"filter({_proposed(kind)}, x -> transform(array(x.m), m -> {KINDS[kind][2]})[0])"
    total = f"if({_near(kind, 'x.s', 'x.e')}, cast({min(1.0, score + CONTEXT)} as double), cast({score} as double))"
    return f"transform({valid}, x -> struct('{kind}' as kind, x.s as start, x.e as end, {total} as score))"


def find(docs: DataFrame) -> DataFrame:
    """doc_id, spans (array of kind, start, end, score; end exclusive) of every row of docs(doc_id, text)."""
    x = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("t"))
    for kind in KINDS:
        x = x.withColumn(f"p_{kind}", F.expr(_spans(kind)))
    parts = [f"p_{kind}" if kind in BASE else f"filter(p_{kind}, x -> x.score >= {LEAST})" for kind in KINDS]
    return x.select("doc_id", F.expr(f"concat({', '.join(parts)})").alias("spans"))


def redact(docs: DataFrame, count: str = "n_found") -> DataFrame:
    """docs with every kind's spans in text replaced by the kind's name in brackets, kind after kind; count names a column of how many."""
    kept = [c for c in docs.columns if c not in ("text", count)]
    x = docs.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("kept"), "text", F.coalesce("text", F.lit("")).alias("t"), F.lit(0).alias("n"))
    needs_context = [k for k in KINDS if k not in BASE and KINDS[k][3] < LEAST]
    for kind in (*needs_context, *(k for k in KINDS if k not in needs_context)):
        pattern, test, valid, *_ = KINDS[kind]
        x = x.withColumn("found", F.expr(f"if({test}, regexp_extract_all(t, '{pattern}', 0), array())"))
        if kind in needs_context:  # as find has it: the match at this place is one of its spans
            x = x.withColumn("at", F.expr(f"if(size(found) = 0, array(), {_proposed(kind)})"))
            x = x.withColumn("right", F.expr(f"zip_with(found, at, (m, x) -> ({valid}) and {_near(kind, 'x.s', 'x.e')})")).drop("at")
        else:
            x = x.withColumn("right", F.expr(f"transform(found, m -> ({valid}))"))
        joined = f"array_join(zip_with(split(t, '{pattern}', -1), zip_with(found, right, (m, ok) -> if(ok, '[{kind.upper()}]', m)), (a, b) -> concat(a, coalesce(b, ''))), '')"
        x = x.withColumns({"t": F.expr(f"if(exists(right, ok -> ok), {joined}, t)"), "n": F.expr("n + size(filter(right, ok -> ok))")})
    text = F.expr("if(text is null, null, t)").alias("text")
    return x.select(*[text if c == "text" else F.col(f"kept.`{c}`") for c in docs.columns if c != count], F.col("n").alias(count))
