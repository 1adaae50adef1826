import numpy as np
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from pagequarry.functions import raster
from pagequarry.operators import classify, facets, geometry, grade, layout, lines, link, segment, select, store
from pagequarry.sources import connectors
from pagequarry.streaming import ingest


def test_smoothing(spark):
    rows = [(1, None, False), (2, "x", True), (3, "y", False), (4, "x", True), (5, None, False), (9, None, False)]
    df = spark.createDataFrame([("b", *r) for r in rows], "book string, n int, auto_type string, strong boolean")
    got = [(r.type, r.type_source) for r in classify.smooth(df, ["book"], ["n"]).orderBy("n").collect()]
    assert got == [("x", "neighbor"), ("x", "rule"), ("x", "neighbor"), ("x", "rule"), ("x", "neighbor"), ("x", "neighbor")]


def test_type_precedence(spark):
    df = spark.createDataFrame([("m", "a", "r"), ("", "a", "r"), (None, "", "r"), (None, None, None)], "m string, a string, r string").coalesce(1)
    value, source = classify.effective_type(F.col("m"), F.col("a"), F.col("r"))
    assert [tuple(r) for r in df.select(value, source).collect()] == [("m", "manual"), ("a", "ai"), ("r", "auto"), ("미분류", "none")]


def test_grade_is_spread_and_order_free(spark):
    rows = [("b", f"i{k}", float(k), None) for k in range(9)]
    a = grade.composite_grade(spark.createDataFrame(rows, "book string, id string, x double, y double"), {"x": 1.0, "y": 1.0}, ["book"], "id")
    b = grade.composite_grade(spark.createDataFrame(rows[::-1], "book string, id string, x double, y double"), {"x": 1.0, "y": 1.0}, ["book"], "id")
    one = {r.id: r.grade_heur for r in a.collect()}
    assert one == {r.id: r.grade_heur for r in b.collect()} and sorted(one.values()) == list(range(1, 10)) and one["i8"] == 1


def test_links(spark):
    p = spark.createDataFrame([("p1", "b", 1, 1), ("p2", "b", 1, 2), ("p3", "b", 2, 1), ("p4", "b", 2, 9)], "problem_id string, book string, section int, number int")
    s = spark.createDataFrame([("s1", "b", 1, 1), ("s2", "b", 1, 2), ("s9", "b", 3, 9)], "solution_id string, book string, section int, number int")
    first = link.match_by_key(p, s, ["book"], ["section", "number"], ["number"])
    assert {(r.problem_id, r.solution_id, r.tier) for r in first.collect()} == {("p1", "s1", "full"), ("p2", "s2", "full"), ("p4", "s9", "short")}
    q = p.withColumn("seq", F.col("number")).withColumn("has_number", F.lit(True)).withColumn("keys", F.array(F.lit("k1"), F.lit("k2")))
    t = spark.createDataFrame([("b", "t1", "k1"), ("b", "t2", "k2")], "book string, solution_id string, key string")
    none = spark.createDataFrame([], "problem_id string, solution_id string")
    got = link.match_greedy(q, t, ["book"], none).collect()
    assert len(got) == 2 and len({r.problem_id for r in got}) == 2 and {r.solution_id for r in got} == {"t1", "t2"}


def test_spatial_match(spark):
    ddl = "book string, id string, page int, x0 double, x1 double, y0 double, page_height double"
    old = spark.createDataFrame([("b", "o1", 1, 0.0, 100.0, 50.0, 1000.0), ("b", "o2", 2, 0.0, 100.0, 50.0, 1000.0)], ddl)
    new = spark.createDataFrame([("b", "n1", 1, 10.0, 90.0, 58.0, 1000.0), ("b", "n2", 1, 0.0, 100.0, 60.0, 1000.0), ("b", "n3", 2, 90.0, 190.0, 50.0, 1000.0)], ddl)
    assert [(r.old_id, r.new_id) for r in link.match_spatial(old, new, ["book"]).collect()] == [("o1", "n1")]


def test_quotas(spark):
    pool = spark.range(500).select(F.col("id"), (1 + F.col("id") % 9).cast("int").alias("grade"))
    for target in (1, 2, 5, 9):
        got = select.select_quota(pool, "id", target, 20, select.MIXES["focus"], 7).collect()
        again = select.select_quota(pool.repartition(3), "id", target, 20, select.MIXES["focus"], 7).collect()
        assert len(got) == 20 and {r.id for r in got} == {r.id for r in again}
        assert sum(r.grade < target for r in got) == (0 if target == 1 else 2)
    assert select.selection_report(pool, pool.limit(3), 20).first().shortage == 17


def test_pool_filters(spark):
    df = spark.createDataFrame([(1, 5, "a"), (2, None, "a"), (3, 4, None), (4, 1, "b")], "id int, grade int, book string")
    ids = lambda **k: sorted(r.id for r in select.filter_pool(df, **k).collect())
    assert ids() == [1, 3, 4] and ids(include={"book": ["a"]}) == [1] and ids(exclude={"book": ["a"]}) == [3, 4] and ids(include={"book": []}, exclude={"book": []}) == [1, 3, 4]


def test_facets(spark):
    df = spark.createDataFrame([("x",), ("x",), ("y",), ("미분류",), ("미분류",), ("미분류",)], "t string")
    assert facets.type_summary(df, "t", unclassified="미분류").first().summary == "x 2, y 1, 미분류 3"
    hist = facets.grade_histogram(spark.createDataFrame([(3,), (3,), (None,)], "grade int")).collect()
    assert len(hist) == 10 and {(r.grade, r.n) for r in hist if r.n} == {(3, 2), (None, 1)}


def test_regions_and_text(spark):
    box = Row("page", "x0", "y0", "x1", "y1")
    df = spark.createDataFrame([([box(1, 0.0, 0.0, 9.0, 9.0)], [box(1, 3.0, 0.0, 9.0, 9.0)], [box(1, 5.0, 0.0, 9.0, 9.0)])], "a array<struct<page:int,x0:double,y0:double,x1:double,y1:double>>, b array<struct<page:int,x0:double,y0:double,x1:double,y1:double>>, c array<struct<page:int,x0:double,y0:double,x1:double,y1:double>>")
    assert tuple(df.select(geometry.same_regions(F.col("a"), F.col("b")), geometry.same_regions(F.col("a"), F.col("c"))).first()) == (True, False)
    ls = spark.createDataFrame([("b", 1, 1, "one", 0.0, 0.0, 10.0, 2.0), ("b", 1, 2, "two", 0.0, 4.0, 10.0, 6.0), ("b", 1, 3, "out", 0.0, 40.0, 10.0, 46.0)], "book string, page int, seq int, text string, x0 double, y0 double, x1 double, y1 double")
    bs = spark.createDataFrame([("b", 1, "i", 0, 0.0, 0.0, 20.0, 10.0)], "book string, page int, id string, part int, x0 double, y0 double, x1 double, y1 double")
    assert geometry.text_in_boxes(ls, bs, ["book"], "id").first().text == "one\ntwo"


def test_export_dedup(spark):
    ddl = "book string, id string, seq int, extra boolean, ai_key string, question string, page int, x0 double, x1 double, y0 double, y1 double"
    rows = [("b", "i1", 1, False, "3", "q", 1, 0.0, 100.0, 0.0, 100.0), ("b", "e1", 2, True, "3", "q", 1, 10.0, 100.0, 10.0, 100.0), ("b", "e2", 3, True, "4", "q", 1, 10.0, 100.0, 10.0, 100.0), ("b", "e3", 4, True, None, "q ", 1, 10.0, 100.0, 50.0, 100.0)]
    got = geometry.drop_overlapping_extras(spark.createDataFrame(rows, ddl), ["book"]).collect()
    assert {r.id for r in got} == {"i1", "e2"}


def test_store(spark, tmp_path):
    old = spark.createDataFrame([("a", 1), ("b", 2)], "id string, v int")
    new = spark.createDataFrame([("b", 3), ("c", 4)], "id string, v int")
    once = store.upsert(old, new)
    assert {tuple(r) for r in once.collect()} == {("a", 1), ("b", 3), ("c", 4)} == {tuple(r) for r in store.upsert(once, new).collect()}
    assert {tuple(r) for r in store.update_many(old, new).collect()} == {("a", 1), ("b", 3)}
    s = store.Snapshots(spark, str(tmp_path / "s"))
    assert s.read("t") is None
    s.write("t", old)
    s.write("t", once)
    assert s.read("t").count() == 3


def test_backup(spark, tmp_path):
    books = spark.createDataFrame([("b1", "Book", None), ("b2", None, "data:image/png;base64,AA==")], "id string, name string, image string")
    pages = spark.createDataFrame([("p1", "b1"), ("p2", None)], "id string, book_id string")
    store.export_backup({"books": books, "pages": pages}, str(tmp_path / "x"))
    extra = spark.createDataFrame([('{"s":"constructor","v":{}}',), ('{"s":"pages","v":{"id":"p',), ("",)], "value string")
    extra.write.text(str(tmp_path / "x" / "9-more"))
    got, bad = store.import_backup(spark, str(tmp_path / "x"), {"books": "id string, name string, image string", "pages": "id string, book_id string"})
    assert {tuple(r) for r in got["books"].collect()} == {("b1", "Book", None), ("b2", "", "data:image/png;base64,AA==")}
    assert [r.id for r in got["pages"].collect()] == ["p1"] and bad.count() == 1


def test_restore_merge(spark):
    ddl = "id string, image string, ai string, level int, note string"
    live = spark.createDataFrame([("1", "img", "mine", 3, "old"), ("2", "img", None, None, "old")], ddl)
    back = spark.createDataFrame([("1", None, "theirs", 5, "new"), ("2", "pic", "theirs", 5, "new"), ("3", None, None, None, "new")], ddl)
    got = {r.id: tuple(r)[1:] for r in store.merge_restored(live, back, "id", ["image"], ["ai", "level"], "ai").collect()}
    assert got == {"1": ("img", "mine", 3, "new", "merged"), "2": ("pic", "theirs", 5, "new", "merged"), "3": (None, None, None, "new", "backup")}


def mark(num, y, x=0.0, page=1, col=0, style="plain", score=1.1, block=True, explicit=0.78, **k):
    return segment.Mark(page, col, 2, 250.0, 800.0, num, style, explicit, k.get("label"), k.get("section"), x, float(y), y + 10.0, 10.0, score, block, False, k.get("circles", 0))


def test_anchor_selection():
    got = segment.select_marks([mark(1, 100), mark(10, 200, x=0.4, score=0.7, block=False), mark(2, 400), mark(3, 600)])
    assert [m.num for m in got] == [1, 2, 3]
    assert [m.num for m in segment.select_marks([mark(1, 100), mark(7, 300), mark(2, 500), mark(3, 700)])] == [1, 2, 3]


def test_numbering_and_chain():
    ms = segment.number_sections([mark(1, 100), mark(2, 200), mark(1, 100, page=2), mark(2, 200, page=2)])
    assert [(m.section, m.num) for m in ms] == [(1, 1), (1, 2), (2, 1), (2, 2)]
    labelled = segment.number_sections([mark(1, 10, label="예제"), mark(1, 20, label="유제"), mark(2, 30, label="예제")])
    assert [(m.label, m.num) for m in labelled] == [("예제", 1), ("유제", 1), ("예제", 2)]
    chain = segment.longest_chain([mark(n, 10 * i, score=s) for i, (n, s) in enumerate([(1, 1), (2, 1), (3, 1), (1, 0.2), (4, 1), (5, 1)])])
    assert [m.num for m in chain] == [1, 2, 3, 4, 5]


def visual(*ys, page=1, score=0.6):
    return [mark(0, y, page=page, style="visual", score=score) for y in ys]


def shown(marks):
    return [f"{m.section}-{m.num}" + "*" * m.inferred for m in marks]


def test_visual_fallback():
    assert shown(segment.number_items([], visual(100, 300, 500))) == ["1-1*", "1-2*", "1-3*"]
    assert shown(segment.number_items([mark(1, 100), mark(4, 700)], visual(300, 500))) == ["1-1", "1-2*", "1-3*", "1-4"]
    # a start on a known line is no item, and more starts than missing numbers leave the surest
    assert shown(segment.number_items([mark(1, 100), mark(3, 700), mark(4, 790)], visual(103, 300, 400, 500))) == ["1-1", "1-2*", "1-3", "1-4"]


def test_numbering_of_restarts():
    known = [mark(n, 100 * n) for n in (1, 2, 3)] + [mark(n, 100 * n, page=2) for n in (3, 4)]
    assert shown(segment.number_items(known, visual(100, 200, page=2))) == ["1-1", "1-2", "1-3", "2-1*", "2-2*", "2-3", "2-4"]
    again = [mark(n, 100 * n) for n in (1, 2)] + [mark(n, 100 * n, page=2) for n in (1, 2)]
    assert shown(segment.number_items(again, [])) == ["1-1", "1-2", "2-1", "2-2"]


def test_numbering_of_misread_numbers():
    odd = segment.number_items([mark(1, 100), mark(2, 200), mark(3, 300), mark(2, 400, score=0.6), mark(9, 500)], [])
    assert shown(odd) == ["1-1", "1-2", "1-3", "1-4*", "1-9"] and odd[3].ocr_number == 2
    # inferred numbers that overran reliable ones make room
    over = segment.number_items([mark(1, 100)] + [mark(n, 100 * n, page=2) for n in (3, 4)], visual(300, 400, 500, 600, 700))
    assert shown(over) == ["1-1", "1-2*", "1-3", "1-4"]
    labelled = segment.number_items([mark(1, 100, label="예제", section=1, style="label"), mark(2, 200, label="예제", section=1, style="label"), mark(1, 300, label="예제", section=2, style="label"), mark(1, 400, label="예제", section=2, style="label")], [])
    assert shown(labelled) == ["1-1", "1-2", "2-1", "2-2"]


def test_segment_end_to_end(spark):
    rows = []
    for page in range(3):
        for col in range(2):
            for k in range(2):
                n, x0, y = page * 4 + col * 2 + k + 1, 40.0 + 270 * col, 100.0 + 300 * k
                rows.append(("b", "problem", page, col, 2, 10 * k, f"{n}. 다음 값을 구하시오", x0, y, x0 + 200, y + 12, x0, x0 + 250, 842.0, 90.0))
                rows += [("b", "problem", page, col, 2, 10 * k + j, "본문 줄입니다", x0, y + 16 * j, x0 + 200, y + 16 * j + 12, x0, x0 + 250, 842.0, 90.0) for j in range(1, 5)]
    ls = spark.createDataFrame(rows, "book_id string, kind string, page int, col int, ncol int, seq int, text string, x0 double, y0 double, x1 double, y1 double, col_x0 double, col_x1 double, page_h double, confidence double")
    pages = spark.createDataFrame([("b", "problem", p, 595.0, 842.0, [(40.0, 290.0), (310.0, 560.0)]) for p in range(3)], "book_id string, kind string, page int, width double, height double, columns array<struct<x0:double,x1:double>>")
    got = sorted(segment.segment(segment.candidates(ls), pages).collect(), key=lambda r: r.number)
    assert [(r.section, r.number) for r in got] == [(1, n) for n in range(1, 13)]
    assert all(1 <= len(r.fragments) <= 6 for r in got)


def test_lines(spark):
    ddl = "page int, str string, x double, y double, width double, height double, col int"
    rows = [(1, "1.", 40.0, 100.0, 10.0, 10.0, 0), (1, "다음", 55.0, 101.0, 20.0, 10.0, 0), (1, "right", 310.0, 100.0, 30.0, 10.0, 1), (1, "below", 40.0, 130.0, 30.0, 10.0, 0)]
    got = lines.items_to_lines(spark.createDataFrame(rows, ddl), ["page"]).collect()
    assert {r.text for r in got} == {"1. 다음", "right", "below"}
    words = spark.createDataFrame([(1, "b", 20.0, 10.0, 30.0, 20.0, 80.0), (1, "a", 0.0, 11.0, 15.0, 21.0, 60.0), (1, "c", 0.0, 40.0, 10.0, 50.0, None)], "page int, text string, x0 double, y0 double, x1 double, y1 double, confidence double")
    assert [(r.text, r.confidence) for r in lines.words_to_lines(words, ["page"]).collect()] == [("a b", 70.0), ("c", None)]


def test_merge_lines(spark):
    ddl = "page int, source string, number int, text string, x0 double, y0 double, x1 double, y1 double"
    rows = [(1, "primary", None, "본문", 30.0, 10.0, 90.0, 20.0), (1, "extra", 3, "3.", 12.0, 10.0, 22.0, 20.0), (1, "extra", None, "new", 10.0, 60.0, 50.0, 70.0), (1, "extra", None, "again", 11.0, 61.0, 50.0, 71.0)]
    got = lines.merge_lines(spark.createDataFrame(rows, ddl), ["page"]).collect()
    assert sorted(r.text for r in got) == ["3. 본문", "new"]


def page(w=1000, h=1200):
    img = np.full((h, w), 255, np.uint8)
    for x in (100, 550):
        for y in (110, 430, 760):
            for k in range(6):
                img[y + 20 * k : y + 20 * k + 9, x : x + 340 : 2] = 0
    return img


def test_raster():
    img = page()
    cols = raster.detect_columns(img)
    assert len(cols) == 2 and 400 < cols[0][1] < cols[1][0] < 600
    starts = raster.block_starts(img, cols)
    assert [(s["col"], s["y0"]) for s in starts] == [(c, y) for c in (0, 1) for y in (110.0, 430.0, 760.0)]
    blank = np.full((300, 300), 255, np.uint8)
    assert raster.trim_box(blank, (0, 0, 300, 300)) is None
    blank[100:121, 100:221] = 0
    assert raster.trim_box(blank, (50, 50, 250, 250)) == (92, 92, 229, 129)
    assert raster.encoding(img) == "png"
    noise = np.random.default_rng(1).integers(0, 255, (200, 200)).astype(np.uint8)
    assert raster.encoding(noise) == "jpeg"
    assert raster.stitch([img, img]).shape == (2408, 1000)


def test_connectors(spark):
    pages = spark.createDataFrame([("p", bytearray(b"x"))], "page_id string, content binary")
    with pytest.raises(Exception):
        connectors.ask_model(spark.createDataFrame([("i", "p", bytearray(b""))], "item_id string, prompt string, content binary"), "x").collect()
    ocr = connectors.recognise(pages, lambda _: '{"lines":[{"text":"1. a","bbox":{"x0":1,"y0":2,"x1":3,"y1":4},"words":[{"text":"1.","confidence":80},{"text":"a","confidence":60}]}]}')
    got = connectors.ocr_lines(ocr).first()
    assert (got.text, got.confidence, got.x0) == ("1. a", 70.0, 1.0)
    assert connectors.recognise(pages).first().ocr is None


def test_page_stream(spark, tmp_path):
    src, n = tmp_path / "in", 3
    src.mkdir()
    for k in range(n):
        (src / f"{k}.json").write_text(f'{{"id":"b:p:{k}","book_id":"b","kind":"problem","index":{k}}}\n')
    s = store.Snapshots(spark, str(tmp_path / "store"))
    q = ingest.ingest(ingest.page_stream(spark, str(src), "id string, book_id string, kind string, index int"), s, str(tmp_path / "cp"))
    q.awaitTermination()
    assert s.read("pages").count() == n and s.read("progress").first().processed_pages == n


def test_log_collapse(spark):
    df = spark.createDataFrame([(1, "page 1/9"), (2, "page 2/9"), (3, "done"), (4, "page 3/9")], "t int, m string")
    assert [r.t for r in ingest.collapse_log(df, "t", "m").orderBy("t").collect()] == [1, 3, 4]


def exam(spark, heights, **k):
    rows = [("e", i, 400, h, 2.0, 400 if i % 2 else None, 200 if i % 2 else None, None, str(i) if i != 1 else None) for i, h in enumerate(heights)]
    return spark.createDataFrame(rows, "exam string, entry int, w int, h int, scale double, solution_w int, solution_h int, solution_scale double, answer string")


def test_answer_key(spark):
    got = {r.row: r.text for r in layout.answer_key(exam(spark, [10] * 7), ["exam"]).collect()}
    assert got == {0: "1. 0      2. -      3. 2      4. 3      5. 4", 1: "6. 5      7. 6"}
    assert layout.answer_key(exam(spark, [10] * 7), ["exam"], 2).count() == 3
    assert layout.answer_key(exam(spark, [10] * 3).withColumn("answer", F.lit(None).cast("string")), ["exam"]).count() == 0


def test_layout_plan(spark):
    entries = exam(spark, [300, 500, 900, 300, 5000, 40])
    for columns in (1, 2):
        for mode in ("pair", "separate"):
            plan = layout.layout_plan(entries, ["exam"], columns, mode).orderBy("block").collect()
            assert {r.entry for r in plan if r.kind == "problem"} == set(range(6)) == {r.entry for r in plan if r.kind == "header"}
            assert sum(r.kind == "solution" for r in plan) == 3 == sum(r.kind == "no_solution" for r in plan)
            assert all(r.y >= layout.MARGIN and r.y + r.h <= layout.BOTTOM + 1e-9 and r.w <= layout.column_width(columns) + 1e-9 for r in plan)
            at = [(r.page, r.col, r.y) for r in plan]
            assert at == sorted(at) and len(set(at)) == len(at)
            assert sum(r.kind == "key_row" for r in plan) == (2 if columns == 1 else 2)
            assert sum(r.kind == "chapter" for r in plan) == (2 if mode == "separate" else 1)
            first = plan[0]
            assert (first.page, first.col, first.y) == (1, 0, layout.MARGIN + layout.TITLE + layout.UNDERLINE)
    head = [r for r in layout.layout_plan(exam(spark, [900, 900]), ["exam"], 1, "separate", key=False).collect() if r.entry == 1 and r.kind in ("header", "problem")]
    assert len({(r.page, r.col) for r in head}) == 1  # a problem stays with its header
    assert layout.layout_plan(entries.limit(0), ["exam"]).count() == 0
