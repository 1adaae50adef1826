"""Whole queries and the pipeline against brute-force versions."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import public_tokenizers
from pagequarry.llm import bpe, decontam, nearcopies, quality, queries
from pagequarry.llm.common import span_hashes
from test_llm import BASE, brute_votes, prose

WORDS = re.compile(r"(?:[0-9A-Za-z\u0080-\U0010ffff]|(?<=[0-9])[,.](?=[0-9]))+")
WIDE = "".join(chr(c) for c in range(0xC0, 0xDF) if c != 0xD7)
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ" + WIDE, "abcdefghijklmnopqrstuvwxyz" + "".join(chr(ord(c) + 32) for c in WIDE))


def brute_words(text):
    """(value, type) of each word; the type is None for a literal one."""
    out, before, end = [], None, 0
    for m in WORDS.finditer(text or ""):
        value = m[0].translate(LOWER)
        if re.fullmatch("[0-9][0-9.,]*", value):
            kind = "number"
        elif before == "number" and value in decontam.UNITS:
            kind = "unit"
        elif out and m[0][0] != value[0] and not re.search("[.!?:\n]", text[end : m.start()]):
            kind = "name"
        else:
            kind = None
        out.append((value, kind))
        before, end = kind, m.end()
    return out


def brute_windows(words, width):
    """start, words, template, whether literal words are half or more."""
    for a in range(len(words) - width + 1):
        w = words[a : a + width]
        yield a, tuple(v for v, _ in w), tuple(k or (v,) for v, k in w), width >= 5 and 2 * sum(k is None for _, k in w) >= width


def slots(words, a, width):
    return [v for v, k in words[a : a + width] if k is not None]


def order(value):
    x = np.frombuffer(value.encode(), np.uint8)
    return int(span_hashes(x, np.array([0]), np.array([len(x)])).view(np.int64)[0])


def brute_matches(rows, items, covered=0.5):
    """(row's place, item_id, n_hit, n_windows, coverage)."""
    out = []
    read = [brute_words(t) for _, t in rows]
    for item_id, text in set(items):
        item = brute_words(text)
        if not item:
            continue
        width = min(8, len(item))
        own = list(brute_windows(item, width))
        same_words, same_template = {}, {}
        for a, exact, template, literal in own:
            same_words.setdefault(exact, []).append(a)
            if literal:
                same_template.setdefault(template, []).append(a)
        for place, words in enumerate(read):
            found = {}
            for b, exact, template, literal in brute_windows(words, width):
                for a in same_words.get(exact, []):
                    found.setdefault(b - a, []).append((a, [], []))
                for a in same_template.get(template, []) if literal else []:
                    found.setdefault(b - a, []).append((a, slots(item, a, width), slots(words, b, width)))
            hits = set()
            for windows in found.values():
                votes = {}
                for _, x, y in windows:
                    for v, w in zip(x, y):
                        votes.setdefault(v, Counter())[w] += 1
                to = {v: max(n, key=lambda w: (n[w], w == v, order(w))) for v, n in votes.items()}
                hits |= {a for a, x, y in windows if x == y or all(to[v] == w for v, w in zip(x, y))}
            literal = {a for a, *_, good in own if good}
            all_share = len(hits) / len(own)
            literal_share = len(hits & literal) / len(literal) if literal else -1
            if max(all_share, literal_share) >= covered:
                use = literal_share >= all_share
                out.append((place, item_id, len(hits & literal) if use else len(hits), len(literal) if use else len(own), max(all_share, literal_share)))
    return out


def questions(rng, n):
    """Items of few words, numbers, units and names, so that templates and values are often shared."""
    vocab = ["the", "train", "Über", "needs", "Maria", "Peter", "and", "has", "3", "4", "12.5", "1,000", "km", "hours", "apples", "more.", "why?", "so", "PARIS", "étage", "x1", "in", "Ann:", "line\n", "日本"]
    return [" ".join(rng.choice(vocab) for _ in range(rng.randint(1, 24))) for _ in range(n)]


def edited(rng, text, share):
    """text with some words replaced: numbers by numbers, names by names, now and then any word by another."""
    to = {}
    out = []
    for w in text.split(" "):
        if rng.random() < share:
            if w[:1].isdigit():
                w = to.setdefault(w, rng.choice(["7", "8", "99", "3"]))
            elif w[:1].isupper():
                w = to.setdefault(w, rng.choice(["Omar", "Lucy", "Peter"]))
            elif rng.random() < 0.2:
                w = "other"
        out.append(w)
    return " ".join(out)


def test_decontamination_query(spark, tmp_path):
    rng = random.Random(17)
    items = list(enumerate(questions(rng, 60))) + [(100, None), (101, ""), (102, " . "), (None, "an item without an id that stands in one document"), (0, "a second text of one id, about 3 km")]
    rows = [(k, prose(rng, 8) + ". " + edited(rng, rng.choice(items)[1] or "", rng.choice([0, 0.3, 1])) + rng.choice([". ", " ", "\n"]) + prose(rng, 8)) for k in range(250)]
    rows += [(500 + k, " ".join(edited(rng, t, 0.5) for t in questions(rng, 3))) for k in range(100)]
    rows += [(900, None), (901, ""), (902, items[-2][1]), (None, items[-1][1]), (None, items[3][1]), (5, rows[5][1]), (903, prose(rng, 4000) + " " + items[-2][1])]
    spark.createDataFrame(rows, "doc_id long, text string").withColumns({"h": F.lit(1), "pos": F.lit("x")}).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").withColumns({"width": F.lit(1), "slots": F.lit("x")}).write.parquet(f"{tmp_path}/benchmark.parquet")
    got = sorted((repr(r.doc_id), repr(r.item_id), r.n_hit, r.n_windows, round(r.coverage, 9)) for r in queries.op3_template_decontamination(spark, str(tmp_path)).collect())
    distinct = list(dict.fromkeys(rows))  # repeated rows count once
    want = sorted((repr(distinct[p][0]), repr(i), n, of, round(c, 9)) for p, i, n, of, c in brute_matches(distinct, items))
    assert got == want and len({d for d, *_ in got}) > 150


def test_recall_of_copies(spark):
    """Of copies with other numbers and names throughout nine in ten or more are found, of verbatim ones all."""
    rng = random.Random(23)
    frame = "the {a} told {b} that {n} of the {m} boxes in the old harbour hall weigh over {n} kg because {a} had put {w} tiles into them"
    names, numbers = ["Anna", "Omar", "Lucy", "Piet"], ["3", "5", "8", "21", "40"]
    items = [(k, frame.format(a=rng.choice(names), b=rng.choice(names), n=rng.choice(numbers), m=prose(rng, 3), w=prose(rng, 4))) for k in range(40)]
    rows = [(k, f"{prose(rng, 20)}. {t}. {prose(rng, 20)}") for k, t in items]
    rows += [(100 + k, f"{prose(rng, 20)}. {re.sub(r'\b[0-9]+\b', rng.choice(['6', '9', '77']), t).replace('Anna', 'Vera').replace('Omar', 'Igor')}. {prose(rng, 20)}") for k, t in items]
    rows += [(200 + k, prose(rng, 60)) for k in range(40)]
    found = {(r.doc_id, r.item_id) for r in decontam.matches(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), by_window=True).collect()}
    assert all((k, k) in found for k in range(40)) and not any(d >= 200 for d, _ in found)
    assert sum((100 + k, k) in found for k in range(40)) >= 36


def brute_features(text):
    data = (text or "").encode()
    shape = [7 if c >= 128 else 0 if 65 <= c <= 90 else 1 if 97 <= c <= 122 else 2 if 48 <= c <= 57 else 3 if c == 32 else 4 if c in (9, 10, 13) else 5 if chr(c) in ".,;:'\"?()-" else 6 for c in data]
    out = np.zeros(quality.GRAMS + quality.SHAPES)
    for a in range(len(data) - 2):
        code = data[a] + (data[a + 1] << 8) + (data[a + 2] << 16)
        out[(code * 2654435761 % (1 << 32)) >> 21] += 1
        out[quality.GRAMS + shape[a] * 64 + shape[a + 1] * 8 + shape[a + 2]] += 1
    return np.log1p(out)


@pytest.fixture(scope="module")
def labelled():
    rng = random.Random(29)
    rows = [(k, prose(rng, rng.randint(5, 90)) if k % 4 else " ".join(w.upper() + "!!" for w in prose(rng, 40).split())) for k in range(400)]
    return rows + [(9000, None), (9001, ""), (9002, "ab"), (None, "abc def"), (9003, prose(rng, 2000)), (7, rows[7][1])]


def test_quality_query(spark, tmp_path, labelled):
    labels = [(d, int(d % 4 != 0), 0) for d, _ in labelled if d is not None and d < 400] + [(8, 1, 0), (None, 0, 0), (7000, None, 1)]
    spark.createDataFrame(labelled, "doc_id long, text string").withColumn("label", F.lit(9)).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    read = lambda n: spark.read.parquet(f"{tmp_path}/{n}.parquet")
    model = quality.fit(read("documents").select("doc_id", "text"), read("labels"))
    out = lambda d: d is not None and zlib.crc32(str(d).encode()) % 3 == 1
    of = {}
    for d, q, _ in labels:
        if d is not None and q is not None and not out(d):
            of.setdefault(d, []).append(q)
    learnt = {d: int(np.mean(q) >= 0.5) for d, q in of.items()}  # every label there is: fewer than PER_CLASS
    assert sorted(model.labels.tolist()) == sorted(float(learnt[d]) for d in learnt) and model.share == pytest.approx(np.mean(list(learnt.values())))
    x = np.stack([brute_features(t) for _, t in labelled]).astype(np.float32)
    assert np.allclose(model.weight, np.log((1 + len(learnt)) / (1 + sum(x[k] > 0 for k in {d: k for k, (d, _) in enumerate(labelled) if d in learnt}.values()))) + 0.1, atol=1e-5)
    want = {repr((d, t)): s if len((t or "").encode()) > 2 else model.share for (d, t), s in zip(labelled, brute_votes(model, x))}
    got = queries.op2_quality_knn(spark, str(tmp_path)).collect()
    by = {}
    for (d, t) in labelled:
        by.setdefault(d, want[repr((d, t))])
    assert sorted((repr(r.doc_id), r.held_out) for r in got) == sorted((repr(d), out(d)) for d, _ in labelled)
    assert all(abs(r.score - by[r.doc_id]) < 2e-3 and r.predicted == int(r.score >= 0.5) for r in got)


def test_candidates(spark):
    bits = [0, 3, 7 << 20, 7 << 20 | 1, 1 << 40 | 1 << 50 | 1 << 60]
    prints = spark.createDataFrame([(k, b, [100 + k, 5 if k in (0, 4) else 200 + k]) for k, b in enumerate(bits)] + [(9, 0, [9]), (10, (1 << 62) - 1, [])], "point long, fp long, bands array<long>")
    got = {r.node: r.root for r in nearcopies.candidates(prints).collect()}
    assert got == {0: 0, 1: 0, 4: 0, 9: 0, 2: 2, 3: 2}


def brute_groups(rows):
    words = [t.lower().split() for _, t in rows]
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in words]
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if root[i] != root[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = root[i], root[j]
                root = [a if v == b else v for v in root]
    return root


def test_pipeline_by_brute_force(spark, tmp_path, labelled):
    import tiktoken

    import corpus_pipeline

    rng = random.Random(37)
    items = [(k, prose(rng, 18).lower() + f" {k + 3} km") for k in range(6)] + [(50, None)]
    rows = [(d, t) for d, t in labelled if d != 7 or t is not labelled[-1][1]]
    good = [(d, t) for d, t in rows if d is not None and d < 400 and d % 4 and len(t.split()) > 30]
    for k, (_, t) in enumerate(good[:40]):
        w = t.split()
        for n in range(1 + k % 5):
            w[(n + 1) * len(w) // 7] = "changed"
        rows.append((1000 + k, " ".join(w)))
    rows += [(2000 + k, f"{prose(rng, 40)}. {re.sub(r'\b[0-9]+\b', '77', items[k % 6][1]) if k % 2 else items[k % 6][1]}. {prose(rng, 40)}") for k in range(12)]
    own = ["me@mail.example.com", "10.20.30.40", "4111 1111 1111 1111", "+49 (30) 1234-5678", "300.1.1.1", "4111 1111 1111 1112"]
    rows += [(3000 + k, f"{prose(rng, 40)} {own[k % 6]} and {own[(k + 1) % 6]}, {prose(rng, 30)}") for k in range(18)]
    docs = spark.createDataFrame([(d, t, "en", "s", 0) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(d, int(d % 4 != 0), 0) for d, _ in labelled if d is not None and d < 400], "doc_id long, quality int, toxic int")
    for name, df in (("documents", docs), ("labels", labels), ("benchmark", spark.createDataFrame(items, "item_id long, text string"))):
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    model = quality.fit(docs.select("doc_id", "text"), labels)
    scores = brute_votes(model, np.stack([brute_features(t) for _, t in rows]).astype(np.float32))
    kept = [(d, t) for (d, t), s in zip(rows, scores) if (t or "").split() and (s if len(t.encode()) > 2 else model.share) >= 0.5]
    root = brute_groups(kept)
    least = {}
    for (d, t), r in zip(kept, root):
        least[r] = min(least.get(r, (True, 0)), (d is None, d or 0))
    kept = [(d, t) for (d, t), r in zip(kept, root) if least[r] == (d is None, d or 0)]
    leaked = {p for p, *_ in brute_matches(kept, items)}
    kept = [x for p, x in enumerate(kept) if p not in leaked]

    def masked(t):
        for kind, pattern, ok in BASE:
            t = re.sub(pattern, lambda m: f"[{kind.upper()}]" if ok(m[0]) else m[0], t)
        return t

    lib = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe._loaded(queries.RANKS).ranks, special_tokens={})
    want = sorted((repr(d), lib.encode_ordinary(masked(t))) for d, t in kept)
    got = sorted((repr(r.doc_id), list(r.ids)) for r in corpus_pipeline.run(spark, str(tmp_path)).collect())
    assert got == want
    assert 20 < len(rows) - len(kept) and len(leaked) == 12 and sum(masked(t) != t for _, t in kept) >= 15
