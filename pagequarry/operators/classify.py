"""Rule classification: weighted rules as a table, arg max, neighbour smoothing and precedence.

A rule is (type_idx, label, kind, expr, weight) over prepared text; kind is
  word    a keyword, its letters perhaps spaced
  token   a word between spaces
  regex   a pattern over the text (in lower case), flat one over it without spaces
  all     names of signals, spaced, that must all hold
and the kinds with a ! in front are guarded: they don't count for a subject that has no use for them. Rules are data of the caller, a
few hundred rows at most, and become one projection: no join, no shuffle, one pass over the texts. Words and tokens are byte
searches; a pattern runs only where its kind asks for one.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.catalogue import UNCLASSIFIED
from ..functions.text import ascii_lower, flat, has_keyword, has_token, nfkc, padded, plain_marks, prepared, squeeze

MIN_SCORE, STRONG, MARGIN, BOOST, SOLUTION = 2.0, 3.0, 1.0, 1.3, 0.5

Rule = tuple[int, str, str, str, float]
#: Name: (field, pattern) of which one must match; field is raw or flat, with capitals.
Signals = Mapping[str, list[tuple[str, str]]]


class Prepared:
    """A text's forms as columns that add() makes once: in lower case with spaces, between spaces, and without any; and its signals."""

    def __init__(self, prefix: str, signals: Signals | None = None):
        self.prefix, self.signals = prefix, dict(signals or {})

    def __getitem__(self, form: str) -> Column:
        return F.col(self.prefix + form)

    def add(self, df: DataFrame, text: Column, normalise: bool, drop: str | None) -> DataFrame:
        df = df.withColumn(self.prefix + "text", prepared(text, normalise, drop))
        df = df.withColumns({self.prefix + "padded": padded(self["text"]), self.prefix + "flat": flat(self["text"])})
        if self.signals:
            c = F.coalesce(text, F.lit(""))
            df = df.withColumn(self.prefix + "raw", squeeze(plain_marks(nfkc(c) if normalise else c)))
            field = {"raw": self["raw"], "flat": flat(self["raw"])}
            df = df.withColumns({f"{self.prefix}is_{k}": reduce(lambda a, b: a | b, [field[f].rlike(p) for f, p in tests]) for k, tests in self.signals.items()})
        return df

    def names(self) -> list[str]:
        return [self.prefix + k for k in ("text", "padded", "flat", "raw", *(f"is_{k}" for k in self.signals))]

    def hit(self, kind: str, expr: str) -> Column:
        kind = kind.removeprefix("!")
        if kind == "token":
            return has_token(self["padded"], expr)
        if kind == "word":
            return has_keyword(self["text"], ascii_lower_str(expr), self["flat"])
        if kind == "all":
            return reduce(lambda a, b: a & b, [self["is_" + k] for k in expr.split()])
        return self["flat" if kind == "flat" else "text"].rlike(expr)


def ascii_lower_str(word: str) -> str:
    return "".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in word)


def _of_label(rules: Iterable[Rule]) -> dict[tuple[int, str], list[Rule]]:
    by: dict[tuple[int, str], list[Rule]] = {}
    for r in rules:
        by.setdefault((r[0], r[1]), []).append(r)
    return dict(sorted(by.items()))


def score(
    df: DataFrame, rules: list[Rule], text: str = "text", solution: str | None = None, favoured: str | None = None, normalise: bool = False,
    signals: Signals | None = None, moves: list[tuple[str, str]] = (), mover: str = "trans", unless: str | None = None, drop: str | None = None, why: bool = False,
) -> DataFrame:
    """df with auto_type (null under MIN_SCORE), auto_score and strong; ties go to the first type. With why, also reasons: up to four rules that hold.

    Rules count whole on text and half on solution. moves (from, to): where the signal mover is seen in either, from's score goes to
    to. favoured names an array column of labels that count BOOST times; where it has unless, nothing moves and guarded rules are out.
    """
    parts = [(Prepared("_t_", signals), text, 1.0)] + ([(Prepared("_s_", signals), solution, SOLUTION)] if solution else [])
    x = df
    for p, column, _ in parts:
        x = p.add(x, F.col(column), normalise, drop)
    open_ = F.lit(True) if favoured is None or unless is None else ~F.coalesce(F.array_contains(F.col(favoured), unless), F.lit(False))
    by = _of_label(rules)
    sums = {}
    for k, own in enumerate(by.values()):
        hits = [F.when((p.hit(kind, e) & open_) if kind.startswith("!") else p.hit(kind, e), F.lit(w * share)).otherwise(F.lit(0.0)) for p, _, share in parts for _, _, kind, e, w in own]
        sums[f"_w{k}"] = reduce(lambda a, b: a + b, hits)
    x = x.withColumns(sums)
    at = {label: f"_w{k}" for k, (_, label) in enumerate(by)}
    moved = {}
    if moves:
        seen = reduce(lambda a, b: a | b, [p["is_" + mover] for p, _, _ in parts]) & open_
        x = x.withColumn("_moving", seen)
        for a, b in moves:
            moved[at[a]] = F.when(F.col("_moving"), F.lit(0.0)).otherwise(F.col(at[a]))
            moved[at[b]] = F.when(F.col("_moving"), F.col(at[a]) + F.col(at[b])).otherwise(F.col(at[b]))
    total = lambda c, label: F.when(F.array_contains(F.col(favoured), label), c * BOOST).otherwise(c) if favoured else c
    entries = [F.struct(total(moved.get(c, F.col(c)), label).alias("score"), F.lit(-idx).alias("order"), F.lit(label).alias("label")) for (idx, label), c in zip(by, at.values())]
    x = x.withColumn("_ranked", F.sort_array(F.array(*entries), asc=False))
    best, second = F.col("_ranked")[0], F.coalesce(F.get(F.col("_ranked"), F.lit(1))["score"], F.lit(0.0))
    x = x.withColumn("auto_type", F.when(best["score"] >= MIN_SCORE, best["label"])).withColumn("auto_score", best["score"])
    x = x.withColumn("strong", (best["score"] >= STRONG) & (best["score"] - F.greatest(second, F.lit(0.0)) >= MARGIN))
    if why:
        to = {b: a for a, b in moves}
        said = [F.when(_counts(label, to) & p.hit(kind, e), F.lit(e)) for p, _, _ in parts for _, label, kind, e, _ in rules]
        x = x.withColumn("reasons", F.slice(F.array_distinct(F.filter(F.array(*said), lambda v: v.isNotNull())), 1, 4))
    return x.drop("_ranked", "_moving", *sums, *(n for p, _, _ in parts for n in p.names()))


def _counts(label: str, to: dict[str, str]) -> Column:
    """The rule's label is the type that was found, or its score has moved there."""
    own = F.col("auto_type") == F.lit(label)
    target = next((b for b, a in to.items() if a == label), None)
    return own if target is None else own | ((F.col("auto_type") == F.lit(target)) & F.col("_moving"))


def smooth(df: DataFrame, group: list[str], order: list[str], label: str = "auto_type", strong: str = "strong", reach: int = 3, near: int = 2) -> DataFrame:
    """df with type and type_source: a weak row takes the type that its nearest strong rows within reach on both sides agree on;
    an untyped row with a strong row on one side alone, within near, takes that."""
    w = Window.partitionBy(*group).orderBy(*order)
    sure = F.when(F.col(strong), F.col(label))
    pick = lambda f, a, b: f(sure, ignorenulls=True).over(w.rowsBetween(a, b))
    prev, next_ = pick(F.last, -reach, -1), pick(F.first, 1, reach)
    prev_near, next_near = pick(F.last, -near, -1), pick(F.first, 1, near)
    x = df.withColumns({"_prev": prev, "_next": next_, "_pn": prev_near, "_nn": next_near})
    weak = ~F.coalesce(F.col(strong), F.lit(False))
    agree = weak & (F.col("_prev") == F.col("_next"))
    lone = F.col(label).isNull() & (F.col("_prev").isNull() | F.col("_next").isNull()) & F.coalesce("_pn", "_nn").isNotNull()
    return (
        x.withColumn("type", F.when(agree, F.col("_prev")).when(lone, F.coalesce("_pn", "_nn")).otherwise(F.col(label)))
        .withColumn("type_source", F.when(agree & ~F.col("_prev").eqNullSafe(F.col(label)), "neighbor").when(lone, "neighbor").when(F.col(label).isNotNull(), "rule"))
        .drop("_prev", "_next", "_pn", "_nn")
    )


def effective_type(manual: Column, model: Column, auto: Column, unclassified: str = UNCLASSIFIED) -> tuple[Column, Column]:
    """The type by precedence (manual, model, automatic; empty strings are missing) and where it is from."""
    some = lambda c: F.nullif(c, F.lit(""))
    value = F.coalesce(some(manual), some(model), some(auto), F.lit(unclassified))
    source = F.when(some(manual).isNotNull(), "manual").when(some(model).isNotNull(), "ai").when(some(auto).isNotNull(), "auto").otherwise("none")
    return value, source


def subject_key(subject: Column, normalise: bool = True) -> Column:
    """A subject's name to look up: NFKC and no spaces."""
    c = F.coalesce(subject, F.lit(""))
    return F.regexp_replace(nfkc(c) if normalise else c, r"\s+", "")


def _map(entries: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in entries.items() for x in kv])


def normalise_types(
    df: DataFrame, value: str, subject: str, labels: list[str], aliases: dict[str, str], none: Iterable[str], subject_types: dict[str, list[str]] | None = None,
    remaps: dict[str, dict[str, str]] | None = None, rules: list[Rule] | None = None, out: str = "type", normalise: bool = True, **scoring,
) -> DataFrame:
    """df with out: a free type name as a known label. A label itself is trusted; an alias, or what rules find in the name, must be one of the
    subject's types or have a remap there. Names for no type, and empty ones, are null. The tables are dictionaries of a fixed size."""
    key = ascii_lower(F.replace(prepared(F.col(value), normalise), F.lit(" "), F.lit("")))
    x = df.withColumns({"_key": key, "_of": subject_key(F.col(subject), normalise)})
    guess = F.try_element_at(_map(aliases), F.col("_key"))
    kept = [*df.columns]
    if rules:
        boosted = subject_types is not None
        if boosted:
            of = F.array(*[F.array(*map(F.lit, v)) for v in subject_types.values()])
            names = F.array(*map(F.lit, subject_types))
            x = x.withColumn("_favoured", F.when(F.array_contains(names, F.col("_of")), F.get(of, F.array_position(names, F.col("_of")).cast("int") - 1)))
        x = score(x.drop("auto_type", "auto_score", "strong"), rules, value, favoured="_favoured" if boosted else None, normalise=normalise, **scoring)
        guess = F.coalesce(guess, F.col("auto_type"))
    x = x.withColumn("_guess", guess)
    if subject_types is not None:
        both = F.concat_ws("|", "_of", "_guess")
        fits = ~F.col("_of").isin(*subject_types) | both.isin(*(f"{k}|{t}" for k, v in subject_types.items() for t in v))
        other = {f"{k}|{a}": b for k, m in (remaps or {}).items() for a, b in m.items()}
        guess = F.when(fits, F.col("_guess")).otherwise(F.try_element_at(_map(other), both) if other else F.lit(None).cast("string"))
    else:
        guess = F.col("_guess")
    exact = F.try_element_at(_map({ascii_lower_str(l.replace(" ", "")): l for l in labels}), F.col("_key"))
    found = F.when(F.col("_key").isin("", *none), F.lit(None).cast("string")).otherwise(F.coalesce(exact, guess))
    x = x.withColumn("_found", found)
    return x.select(*[c for c in kept if c != out], F.col("_found").alias(out))


def by_prefix(topic: Column, names: list[str]) -> Column:
    """The longest of the names that topic starts with."""
    hits = F.filter(F.array(*[F.when(F.startswith(topic, F.lit(n)), F.struct(F.lit(len(n)).alias("n"), F.lit(n).alias("name"))) for n in names]), lambda x: x.isNotNull())
    return F.array_max(hits)["name"]


def type_rank(label: Column, labels: list[str], unclassified: str = UNCLASSIFIED) -> Column:
    """Place of a type: known labels in their order, then labels of people's own, then unclassified."""
    known = F.array(*map(F.lit, labels))
    return F.when(F.array_contains(known, label), F.array_position(known, label).cast("int") - 1).when(label == unclassified, len(labels) + 1).otherwise(len(labels))


def type_order(label: str, labels: list[str], unclassified: str = UNCLASSIFIED, collation: str = "ko") -> list[Column]:
    """Columns to order types by: type_rank, then the names by a locale's collation."""
    return [type_rank(F.col(label), labels, unclassified), F.collate(F.col(label), collation)]
