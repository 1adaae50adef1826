"""Types, orders, selection, ranges, the store, services and the ingest of a book."""

import base64

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagequarry.functions import catalogue, jsonfix, raster
from pagequarry.operators import classify, geometry, ingest, order, segment, select, store
from pagequarry.sources import connectors
from pagequarry.streaming import ingest as stream

RULES = [
    (8, "삼각함수", "flat", "sin|cos|tan", 3.0), (9, "수열", "word", "수열", 3.0), (11, "다항함수의 미분", "word", "도함수", 3.0), (14, "여러 가지 함수의 미분", "!all", "diff trans", 3.0), (14, "여러 가지 함수의 미분", "!regex", "(^|[^a-z])ln( |$)", 3.0),
    (12, "다항함수의 적분", "word", "적분", 2.0), (15, "여러 가지 함수의 적분", "word", "부피", 2.0), (17, "확률", "token", "확률", 3.0),
]
HOW = {"signals": catalogue.SIGNALS, "moves": catalogue.MOVES, "unless": catalogue.POLYNOMIAL}


def test_signals_and_moves(spark):
    rows = [(1, "도함수를 구하라", None, None), (2, "sin x 의 도함수", None, None), (3, "sin x 의 도함수", None, catalogue.SUBJECT_TYPES["수학II"]), (4, "적분", "e^x", None), (5, "확률 변수 확률분포", None, None), (6, None, None, None), (7, "수열", None, ["수열"])]
    df = spark.createDataFrame(rows, "id int, text string, sol string, fav array<string>")
    got = {r.id: (r.auto_type, round(r.auto_score, 4), r.reasons) for r in classify.score(df, RULES, solution="sol", favoured="fav", why=True, **HOW).collect()}
    assert got[1] == ("다항함수의 미분", 3.0, ["도함수"])
    assert got[2] == ("여러 가지 함수의 미분", 6.0, ["도함수", "diff trans"])  # moved there, and its own rule
    assert got[3][:2] == ("다항함수의 미분", 3.9)  # a subject without transcendental functions
    assert got[4][:2] == ("여러 가지 함수의 적분", 2.0) and got[5] == ("확률", 3.0, ["확률"])
    assert got[6][:2] == (None, 0.0) and got[7][:2] == ("수열", 3.9)


def test_type_names(spark):
    cases = [("다항식", "기하", "다항식"), ("미분", "미적분", "여러 가지 함수의 미분"), ("미분", "수학 II", "다항함수의 미분"), ("삼각함수의 극한 sin", "미적분", "여러 가지 함수의 미분"), ("기타", "수학I", None), ("", None, None), (None, None, None), ("수열의 합", "기하", None), ("수열의 합", None, "수열"), ("N/A", None, None), ("여러 가지  함수의 미분", "수학I", "여러 가지 함수의 미분")]
    df = spark.createDataFrame([(k, v, s) for k, (v, s, _) in enumerate(cases)], "id int, v string, s string")
    how = dict(labels=catalogue.TYPES, aliases=catalogue.ALIASES, none=catalogue.NO_TYPE, subject_types=catalogue.SUBJECT_TYPES, remaps=catalogue.REMAPS, rules=RULES, **HOW)
    got = {r.id: r.type for r in classify.normalise_types(df, "v", "s", **how).collect()}
    assert [got[k] for k in range(len(cases))] == [w for _, _, w in cases]
    problem = "struct<topic:string,passage:string,question:string,choices:array<string>>"
    df = spark.createDataFrame([(1, ("수학 I - 수열", None, "q", []), "수학I"), (2, ("무엇", None, r"\sin x", None), None), (3, (None, None, None, None), None)], f"id int, p {problem}, s string")
    assert {r.id: r.type_llm for r in jsonfix.types_from_analysis(df, "p", "s", **how).collect()} == {1: "수열", 2: "삼각함수", 3: None}


def test_orders(spark):
    rows = [("d", "예제", 1, 1), ("a", None, 2, 1), ("b", "", 1, 9), ("c", "유제", 1, 1), ("e", None, 1, 9), ("f", "예제", 1, 2)]
    df = spark.createDataFrame(rows, "id string, label string, section int, number int")
    assert [r.id for r in df.orderBy(*order.item_order()).collect()] == ["b", "e", "a", "d", "f", "c"]
    types = spark.createDataFrame([("미분류",), ("나의 유형",), ("수열",), ("가 유형",), ("다항식",)], "type string")
    assert [r.type for r in types.orderBy(*classify.type_order("type", catalogue.TYPES)).collect()] == ["다항식", "수열", "가 유형", "나의 유형", "미분류"]
    assert {r.type: r.rank for r in order.group_ranks(types, "type", labels=catalogue.TYPES).collect()} == {"다항식": 1, "수열": 2, "가 유형": 3, "나의 유형": 4, "미분류": 5}
    books = spark.createDataFrame([("y", "2024-01-02"), ("x", "2024-01-03"), ("z", None)], "id string, created_at string")
    shown = spark.createDataFrame([("x",), ("y",), ("y",)], "book_id string")
    assert {r.book_id: r.rank for r in order.group_ranks(shown, "book_id", books).collect()} == {"y": 1, "x": 2}
    assert [r.id for r in books.orderBy(*order.book_order()).collect()] == ["z", "y", "x"]
    assert [r.id for r in order.first_of(df, order.item_order(), 2).collect()] == ["b", "e"]
    assert order.first_of(df, order.item_order(), 1, ["section"]).count() == 2


def test_chosen_order(spark):
    pool = spark.range(90).select("id", (1 + F.col("id") % 9).cast("int").alias("grade"), (F.col("id") % 4).alias("book"))
    got = select.select_quota(pool, "id", 5, 30, select.MIXES["review"], 3, order=["book"]).collect()
    assert [(-r.grade, r.book, r.id) for r in got] == sorted((-r.grade, r.book, r.id) for r in got) and len(got) == 30
    few = select.select_quota(pool.where("id < 7"), "id", 5, 30, select.MIXES["review"], 3).collect()
    assert sorted(r.id for r in few) == list(range(7))
    assert select.select_quota(pool.limit(0), "id", 5, 30, select.MIXES["review"], 3).count() == 0


def test_ranges_by_bins(spark):
    rng = np.random.default_rng(4)
    points = spark.createDataFrame([(k, int(s), float(x)) for k, (s, x) in enumerate(zip(rng.integers(0, 3, 80), rng.uniform(-50, 50, 80)))], "id int, s int, x double")
    spans = spark.createDataFrame([(k, int(s), float(a), float(a + w)) for k, (s, a, w) in enumerate(zip(rng.integers(0, 3, 60), rng.uniform(-50, 50, 60), rng.uniform(0, 30, 60)))], "n int, s int, a double, b double")
    pairs = lambda df: sorted((r.id, r.n) for r in df.collect())
    assert pairs(geometry.point_in_interval(points, "x", spans, "a", "b", ["s"], 7.0)) == pairs(geometry.point_in_interval(points, "x", spans, "a", "b", ["s"]))
    both = lambda **k: sorted((r.a, r.b) for r in geometry.overlap_pairs(spans, ["s"], "n", "a", "b", **k).collect())
    assert both(width=5.0) == both() != []
    other = points.select(F.col("id").alias("o"), "s", (F.col("x") + 0.5).alias("y"))
    want = sorted((p.id, o.o) for p in points.collect() for o in other.collect() if p.s == o.s and abs(p.x - o.y) <= 3.0)
    assert sorted((r.id, r.o) for r in geometry.near_pairs(points, other, ["s"], "x", "y", 3.0).collect()) == want


def test_lookups(spark):
    df = spark.createDataFrame([("a", "b1", 1), ("b", "b1", 2), ("c", None, 3)], "id string, book_id string, v int")
    assert store.lookup(df, book_id="b1").count() == 2 and [r.id for r in store.keys_of(df, book_id=None).collect()] == ["c"]
    assert store.point(df, "b").v == 2 and store.point(df, "z") is None
    seen = []
    assert store.for_each(df, lambda r: seen.append(r.id), book_id="b1") == 2 and sorted(seen) == ["a", "b"]

    def fails(_):
        raise KeyError("stop")

    with pytest.raises(KeyError):
        store.for_each(df, fails)
    assert store.count_updated(df, spark.createDataFrame([("a", 9), ("z", 9)], "id string, v int")) == 1


def test_snapshots_of_several_tables(spark, tmp_path):
    s = store.Snapshots(spark, str(tmp_path / "s"))
    a, b = spark.createDataFrame([("x", 1)], "id string, v int"), spark.createDataFrame([("y", "007")], "id string, book_id string")
    s.commit({"a": a, "b": b}, {"b": ["book_id"]})
    assert s.read("b").first().book_id == "007"  # a partition's text stays text

    class Broken:
        schema, write = a.schema, property(lambda self: 1 / 0)

    with pytest.raises(ZeroDivisionError):
        s.commit({"a": a.withColumn("v", F.lit(2)), "b": Broken()})
    assert s.read("a").first().v == 1
    rows = lambda *r: spark.createDataFrame(r, "id string, book_id string, v int")
    s.upsert_slices("p", rows(("1", "01", 1), ("2", "01", 1), ("3", "02", 1)), ["book_id"])
    kept = set((tmp_path / "s" / "p" / "slices" / "book_id=02").glob("*.parquet"))
    back = s.upsert_slices("p", rows(("2", "01", 5), ("4", "01", 5)), ["book_id"])
    assert sorted((r.id, r.book_id, r.v) for r in s.read("p").collect()) == [("1", "01", 1), ("2", "01", 5), ("3", "02", 1), ("4", "01", 5)]
    assert back.count() == 3 and kept == set((tmp_path / "s" / "p" / "slices" / "book_id=02").glob("*.parquet"))
    assert s.upsert_slices("p", rows(("9", "01", 1)).limit(0), ["book_id"]) is None


def test_old_backups(spark, tmp_path):
    (tmp_path / "ok.json").write_text('{"books":[{"id":"b","name":"n"},{"name":"x"}],\n"pages":[{"id":"p","book_id":"b","image":"https://x"},{"id":"q","book_id":"b"}],"items":null}')
    schemas = {"books": "id string, name string, page_counts struct<problem:int,solution:int>", "pages": "id string, book_id string, image string, image_missing boolean", "items": "id string, book_id string, fragments array<int>"}
    got = store.import_backup_v1(spark, str(tmp_path / "ok.json"), schemas)
    assert [(r.id, r.page_counts.problem) for r in got["books"].collect()] == [("b", 0)]
    assert [(r.id, r.image_missing) for r in got["pages"].collect()] == [("q", True)] and got["items"].count() == 0
    for k, bad in enumerate(('{"pages": []}', "no json", '{"books": [], "items": 3}')):
        (tmp_path / f"{k}.json").write_text(bad)
        with pytest.raises(ValueError):
            store.import_backup_v1(spark, str(tmp_path / f"{k}.json"), schemas)


def test_streamed_restore(spark, tmp_path):
    books = spark.createDataFrame([("b1", "Book"), ("b2", "Two")], "id string, name string")
    pages = spark.createDataFrame([("p1", "b1", None), ("p2", "b2", "data:image/png;base64,AA==")], "id string, book_id string, image string")
    counts = store.export_backup({"books": books, "pages": pages}, str(tmp_path / "x"))
    assert counts["pages"].rows == 2
    spark.createDataFrame([('{"s":"pages","v":{"id":"p',)], "value string").write.text(str(tmp_path / "x" / "9-cut"))
    s = store.Snapshots(spark, str(tmp_path / "store"))
    q = stream.restore_stream(stream.lines_stream(spark, str(tmp_path / "x")), s, {"books": "id string, name string", "pages": "id string, book_id string, image string"}, str(tmp_path / "cp"))
    q.awaitTermination()
    assert s.read("books").count() == 2 and sorted(r.id for r in s.read("pages").collect()) == ["p1", "p2"] and s.read("bad_lines").count() == 1


def test_pictures_move_to_files(spark, tmp_path):
    url = lambda b: "data:image/png;base64," + base64.b64encode(b).decode()
    ddl = "id string, book_id string, role string, image string, image_id string, image_ref " + store.REF + ", image_bytes long"
    rows = [("a", "k/1", "page-problem", url(b"one"), "i1", None, None), ("b", "k/1", "page-problem", "https://x", "i2", None, None), ("c", "k2", "item", url(b"three"), "i3", None, None), ("d", "k3", "item", url(b"four"), "i4", None, None), ("e", "k3", "item", None, None, None, None)]
    records = spark.createDataFrame(rows, ddl)
    folder = f"file://{tmp_path}/files"
    todo = store.movable(records, spark.createDataFrame([("k3",)], "book_id string"))
    moved = store.place_images(todo, folder).join(todo.select("id", "image_id"), "id").collect()
    moved = spark.createDataFrame(moved, "id string, image_ref " + store.REF + ", error string, image_id string")
    now = records.withColumn("image_id", F.when(F.col("id") == "c", "new").otherwise(F.col("image_id")))  # c changed meanwhile
    done, lost = store.apply_moved(now, moved)
    got = {r.id: r for r in done.collect()}
    assert got["a"].image is None and got["a"].image_ref.size == 3 and got["a"].image_bytes == 3 and got["a"].image_id != "i1"
    assert got["b"].image == "https://x" and got["c"].image and got["c"].image_ref is None and got["d"].image
    assert tuple(store.move_report(todo, moved, lost).first()) == (3, 1, 1, 1)
    assert (tmp_path / "files" / "k_1" / got["a"].image_ref.file).read_bytes() == b"one"
    assert [r.removed for r in store.remove_files(lost, folder).collect()] == [True] == [r.removed for r in store.remove_files(lost, folder).collect()]
    assert len(list((tmp_path / "files").rglob("*.png"))) == 1
    sizes = spark.createDataFrame([("b", 5 << 30), ("b", 0), ("c", 1000), ("d", 3 << 20)], "book_id string, image_bytes long")
    assert {r.book_id: (r.pictures, r.shown) for r in store.storage(sizes).collect()} == {"b": (1, "5.0GB"), "c": (1, "0.1MB"), "d": (1, "3.0MB")}


def test_retries():
    E = connectors.ServiceError
    assert [connectors.wait_after(E("x", 429), k) for k in range(4)] == [2.0, 4.0, 8.0, None]
    assert connectors.wait_after(E("x", 404), 0) is None and connectors.wait_after(E("x", unreadable=True), 0) == 1.0
    assert connectors.wait_after(E("x", unreadable=True), 1) is None and connectors.wait_after(E("x", unreadable=True, truncated=True), 0) is None
    assert connectors.stops_run(E("x", 401)) and not connectors.stops_run(E("x", 500))


def test_access_errors_end_a_run(spark):
    def call(text, content):
        raise connectors.ServiceError("no key", 401)

    items = spark.createDataFrame([(str(k), "p", bytearray(b"")) for k in range(3)], "item_id string, prompt string, content binary").coalesce(1)
    assert [(r.raw, r.error) for r in connectors.ask_model(items, "x", call, wait_s=60).collect()] == [(None, "no key")] * 3


def test_replies_are_compared_and_set(spark):
    ddl = "id string, image_id string, ai_problems array<string>, difficulty_llm int, grade_llm int, llm_reason string, unit string, type_llm string, subject_llm string, ai_stale boolean"
    items = spark.createDataFrame([("a", "i1", None, 2, 7, "old", None, None, "수학I", True), ("b", "new", None, 3, 5, "old", None, None, None, True)], ddl)
    said = "id string, image_id string, problems array<string>, difficulty int, grade_llm int, llm_reason string, topic string, type_llm string, subject_llm string"
    answers = spark.createDataFrame([("a", "i1", ["p"], None, None, "r", "t", "수열", None), ("b", "i2", ["p"], 4, 3, "r", "t", None, "x"), ("z", "i", ["p"], 4, 3, "r", "t", None, None)], said)
    done, report = connectors.apply_replies(items, answers)
    got = {r.id: r for r in done.collect()}
    assert (got["a"].difficulty_llm, got["a"].llm_reason, got["a"].type_llm, got["a"].subject_llm, got["a"].ai_stale) == (None, None, "수열", "수학I", False)
    assert (got["b"].difficulty_llm, got["b"].unit, got["b"].ai_stale) == (3, None, True)
    assert {r.id: (r.saved, r.why) for r in report.collect()} == {"a": (True, None), "b": (False, "recut"), "z": (False, "gone")}


def test_logs_by_book(spark):
    df = spark.createDataFrame([("a", 1, "page 1/9"), ("b", 2, "page 2/9"), ("a", 3, "page 2/9"), ("a", 4, "done"), ("b", 5, None), ("b", 6, None)], "book string, t int, m string")
    assert sorted(r.t for r in stream.collapse_log(df, "t", "m", ["book"]).collect()) == [1, 2, 4, 5]


def test_strips(spark):
    pages = spark.createDataFrame([("p", 1000, [(50.0, 480.0), (520.0, 950.0), (999.0, 1003.0)])], "page_id string, width int, columns array<struct<x0:double,x1:double>>")
    got = sorted(connectors.strips(pages).collect(), key=lambda r: r.col)
    assert [(r.x0, r.x1) for r in got] == [(44.0, 203.0), (514.0, 673.0), (993.0, 1000.0)]
    ocr = '{"lines":[{"text":"3.","confidence":90,"bbox":{"x0":13.5,"y0":135,"x1":9999,"y1":162}}]}'
    row = connectors.strip_lines(spark.createDataFrame([("p", 0, 44.0, 203.0, 1.35, ocr)], "page_id string, col int, x0 double, x1 double, zoom double, ocr string")).first()
    assert (row.x0, row.x1, round(row.y0), round(row.y1), row.source) == (54.0, 203.0, 100, 120, "number-strip")


def scan(numbers):
    """A picture of a page with a column of blocks, and its text items."""
    img, items = np.full((842, 595), 255, np.uint8), []
    for k, n in enumerate(numbers):
        y = 100 + 180 * k
        for j in range(4):
            img[y + 20 * j : y + 20 * j + 10, 60:520:2] = 20
        texts = [f"{n}. 다음 식의 값을 구하시오", "함수 f(x)에 대하여 정답 ③", "[4점] 조건을 만족시키는 값", "① 1 ② 2 ③ 3"]
        items += [(t, 60.0, float(y + 20 * j + 10), 400.0, 10.0) for j, t in enumerate(texts)]
    return img, items


def test_book_from_pages(spark, tmp_path):
    images, texts, blind = [], [], set()
    for kind, pages in (("problem", [(1, 2, 3), (4, 5)]), ("solution", [(1, 2, 3)])):
        for p, numbers in enumerate(pages):
            img, items = scan(numbers)
            images.append(("bk", kind, p + 1, ("x", 842, 595, 1, 0, bytearray(img.tobytes()))))
            if (kind, p) == ("problem", 1):
                blind.add(bytes(img.tobytes()))  # a page without a text layer, for recognition
            else:
                texts += [("bk", kind, p + 1, *t) for t in items]
    image = "struct<origin:string,height:int,width:int,nChannels:int,mode:int,data:binary>"
    images = spark.createDataFrame(images, f"book_id string, kind string, page int, image {image}")
    texts = spark.createDataFrame(texts, "book_id string, kind string, page int, str string, x double, y double, width double, height double")

    def recognise(content):
        assert bytes(content) in blind
        return '{"lines":[' + ",".join('{"text":"%d. 다음 식의 값은?","confidence":90,"bbox":{"x0":60,"y0":%d,"x1":500,"y1":%d}}' % (n, 100 + 180 * k, 110 + 180 * k) for k, n in enumerate((4, 5))) + "]}"

    made = iter(range(99))

    def keep(df, label):
        at = str(tmp_path / f"{label}-{next(made)}")
        df.write.parquet(at)
        return spark.read.schema(df.schema).parquet(at)

    pages = keep(ingest.read_pages(images, texts, recognise, keep=keep), "done")
    got = {(r.kind, r.page): r for r in pages.collect()}
    assert len(got) == 3 and got["problem", 2].ocr and not got["problem", 1].ocr and got["problem", 1].diagnostics.lexical_candidates == 3
    assert [len(got[k].columns) for k in sorted(got)] == [1, 1, 1]
    s = store.Snapshots(spark, str(tmp_path / "s"))
    of = lambda kind: (lambda: pages.where(F.col("kind") == kind))
    pictures = {k: images.where(F.col("kind") == k) for k in ("problem", "solution")}
    status = ingest.ingest_book(s, {"id": "bk", "name": "Book", "level": "auto"}, {"problem": of("problem"), "solution": of("solution")}, pictures)
    assert status == "complete"
    items = s.read("items").collect()
    assert sorted((r.kind, r.section, r.number) for r in items) == [*(("problem", 1, n) for n in range(1, 6)), *(("solution", 1, n) for n in range(1, 4))]
    one = next(r for r in items if r.kind == "problem" and r.number == 1)
    assert one.points == 4 and one.text.startswith("1. 다음") and one.h < 200 and raster.png(np.zeros((1, 1), np.uint8))[:8] == bytes(one.picture)[:8]
    links = {r.id: r for r in s.read("links").where("solution_id is not null").collect()}
    assert len(links) == 3 and {r.linked_answer for r in links.values()} == {"③"}
    book = s.read("books").first()
    assert (book.status, book.problems, book.matched) == ("complete", 5, 3)
    with pytest.raises(ingest.PicturesMissing):
        ingest.segment_kind(pages.where("kind = 'problem'"), pictures["problem"].where("page = 1"))
    assert ingest.claim(s, "bk") and not ingest.claim(s, "bk") and ingest.claim(s, "bk", now_ms=1 << 45)


def test_line_merging_by_source(spark):
    from pagequarry.operators import lines

    ddl = "page int, source string, number int, text string, x0 double, y0 double, x1 double, y1 double, fw_x0 double, fw_x1 double"
    rows = [
        (1, "primary", None, "정답 ③ 에서", 91.0, 141.0, 491.0, 163.0, 91.0, 121.0), (1, "ocr", 9, "9 정답", 90.0, 140.0, 490.0, 162.0, 90.0, 120.0),
        (1, "primary", None, "다음 값은?", 124.0, 300.0, 524.0, 322.0, 124.0, 154.0), (1, "ocr", 3, "3. 다음", 80.0, 300.0, 480.0, 322.0, 80.0, 102.0),
        (1, "primary", None, "함수", 124.0, 500.0, 524.0, 522.0, 124.0, 154.0), (1, "number-strip", 4, "4.", 120.0, 500.0, 150.0, 522.0, 120.0, 140.0),
    ]
    got = [r.text for r in lines.merge_lines(spark.createDataFrame(rows, ddl), ["page"]).orderBy("y0").collect()]
    assert got == ["정답 ③ 에서", "3. 다음 값은?", "4. 함수"]
