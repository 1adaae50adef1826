"""Recognition on drawn pages: lines, visual starts and items, all books in one segmentation."""

import time

import numpy as np
import pytest

from pagequarry.functions import raster
from pagequarry.operators import segment

W, H, LINE, STEP = 1190, 1684, 22, 34
COLUMNS = [(90.0, 575.0), (615.0, 1100.0)]
TEXT = "text x0 y0 x1 y1 fw_text fw_x0 confidence source".split()


def line(text, x, y, width=260, word=None, source="ocr", confidence=90.0):
    word = text.split()[0] if word is None else word
    return dict(zip(TEXT, (text, float(x), float(y), float(x + width), float(y + LINE), word, float(x), confidence, source)))


def start(y, ink_x0=None, col=0, sure=0.6):
    return {"col": col, "y0": float(y), "y1": float(y + 22), "cut_y": float(y - 10), "h": 22.0, "ink_x0": ink_x0, "confidence": sure, "top": False, "top_gap": False}


def small(lines, starts=()):
    """A page of one column."""
    return {"width": 700.0, "height": 1000.0, "columns": [(100.0, 600.0)], "lines": lines, "starts": list(starts), "bottoms": None}


class Draw:
    """A page with two columns; blocks write lines and leave ink."""

    def __init__(self, top=140):
        self.img, self.lines, self.top = np.full((H, W), 255, np.uint8), [], top
        self.dots = (np.arange(W)[None, :] * 7 + np.arange(H)[:, None] * 13) % 5 == 0
        self.col, self.y = 0, top

    def ink(self, x0, y0, x1, y1, solid=False):
        part = np.s_[int(y0) : int(y1), int(x0) : int(x1)]
        self.img[part] = np.where(self.dots[part] | solid, 20, self.img[part])

    def write(self, text, dx=0, width=440, word=None):
        x = COLUMNS[self.col][0] + dx
        self.ink(x, self.y + 4, x + width, self.y + LINE - 3)
        self.lines.append(line(text, x, self.y, width, word, "text", None))
        self.y += STEP

    def figure(self, height):
        x = COLUMNS[self.col][0]
        self.ink(x + 150, self.y, x + 152, self.y + height, True)
        self.ink(x + 100, self.y + height - 20, x + 330, self.y + height - 18, True)
        self.y += height + 20

    def problem(self, number, read=True, opening="다음 식의 값은?", figure=0, word=None):
        if read:
            self.write(f"{number} {opening}", word=word or str(number).split()[0])
        else:
            x = COLUMNS[self.col][0]
            self.ink(x, self.y + 2, x + 26, self.y + LINE - 2, True)
            self.write(opening, 36, 404)
        self.write("함수 f(x)=x^2-4x+3 에 대하여", 36, 404)
        if figure:
            self.y += 20
            self.figure(figure)
        self.y += 16
        self.write("① 1 ② 2 ③ 3 ④ 4 ⑤ 5", 36, 420)
        self.y += 90

    def prose(self, count):
        for _ in range(count):
            self.write("개념 설명 문장이 이어진다 개념 설명 문장이 이어진다", width=470)
        self.y += 50

    def solution(self, number, count=2):
        self.write(f"{number:02d} 정답 ③", width=200)
        for _ in range(count):
            self.write("풀이 과정을 정리하면 다음과 같다")
        self.y += 50

    def next(self):
        self.col, self.y = 1, self.top
        return self

    def page(self):
        return {"width": float(W), "height": float(H), "columns": COLUMNS, "lines": self.lines, "starts": raster.block_starts(self.img, COLUMNS), "bottoms": raster.ink_bottoms(self.img, COLUMNS)}


def problems(left, right, top=140, read=True):
    d = Draw(top)
    for n in left:
        d.problem(f"{n:02d}" if isinstance(n, int) else n, read)
    d.next()
    for n in right:
        d.problem(f"{n:02d}" if isinstance(n, int) else n, read)
    return d.page()


def section(first):
    return [problems((first, first + 1), (first + 2, first + 3)), problems((first + 4, first + 5), (first + 6, first + 7))]


def concept():
    d = Draw()
    d.prose(5)
    d.prose(5)
    d.next().prose(5)
    d.prose(4)
    return d.page()


def headed():
    d = Draw()
    d.write("유형 02  로그의 성질", width=300)
    d.y += 30
    d.prose(2)
    d.problem("07")
    d.problem("08")
    d.next().problem("09")
    d.problem("10")
    return d.page()


def full():
    d = Draw()
    for n in (1, 2, 3):
        d.problem(f"{n:02d}")
    d.next()
    for n in (4, 5):
        d.problem(f"{n:02d}")
    d.problem("06", figure=540)
    return d.page()


def solutions():
    a, b = Draw(), Draw()
    for n in (1, 2, 3):
        a.solution(n)
    a.next()
    for n, k in ((4, 2), (5, 2), (6, 25)):
        a.solution(n, k)
    b.write("그래프는 다음과 같다", 36, 380)
    b.figure(180)
    b.y += 50
    b.write("따라서 구하는 값은", 36, 380)
    b.write("12 이다.", 36, 380)
    b.y += 50
    b.solution(7)
    b.next().solution(8)
    return [a.page(), b.page()]


def restart():
    d = Draw()
    d.problem("01", False)
    d.problem("02", False)
    d.next().problem("03")
    d.problem("04")
    return [*section(1), d.page(), problems((5, 6), (7, 8))]


def quantities(*second):
    """Solutions as text, one of which has lines that open with a quantity."""
    lines = []
    for col, numbers in enumerate(((1, 2), (3, 4))):
        y = 140
        for n in numbers:
            for t, w in [(f"{n:02d} 정답 ③", 200), *[(t, 460) for t in (second if n == 4 else ())], ("f(x)=x^2-4x+3에서", 460), ("따라서 구하는 값은 ③이다.", 460)]:
                lines.append(line(t, COLUMNS[col][0], y, w, source="text", confidence=None))
                y += STEP
            y += 50
    return {"width": float(W), "height": float(H), "columns": COLUMNS, "lines": lines, "starts": [], "bottoms": None}


def labels():
    lines, y = [], 140
    for k in (1, 2, 3):
        for label in ("예제", "유제"):
            for t in (f"{label} {k} 다음 식을 계산하시오.", "식의 값을 구하시오."):
                lines.append(line(t, 90, y, 410, source="text"))
                y += STEP
            y += 80
    return {"width": float(W), "height": float(H), "columns": COLUMNS[:1], "lines": lines, "starts": [], "bottoms": None}


def choices(n):
    rows = [(f"{2 * n - 1}. 다음 중 옳은 것은?", 102, 100), ("① 1  ② 2  ③ 3", 130, 180), ("④ 4  ⑤ 5", 130, 215), (f"{2 * n}. 함수의 값은?", 102, 400)]
    rows += [(f"{c} {k}", 130, 470 + 30 * k) for k, c in enumerate("①②③④⑤")] + [("(1) 극값을 구하시오.", 130, 650), ("(2) 넓이를 구하시오.", 130, 720)]
    return small([line(*r) for r in rows], [start(100), start(400)])


def run(first, last, sec=1):
    return [f"{sec}-{n}" for n in range(first, last + 1)]


three = lambda *ls: small([line(*l) for l in ls], [start(100), start(400), start(700)])
ends = lambda *ls: small([line(*l) for l in ls], [start(100, 102.0), start(400, 180.0), start(700, 102.0)])
later = lambda *ls: small([line(*l) for l in ls], [start(100, 102.0), start(400, 102.0), start(700, 180.0)])

#: name: (kind, pages, keys of the items; * marks inferred ones)
BOOKS = {
    "body number": ("problem", [small([line("1. 다음 식의 값은?", 102, 100), line("10. 을 넘지 않는다", 275, 200), line("2. 함수 f(x)", 102, 400)], [start(100), start(400)])], ["1-1", "1-2"]),
    "incoherent": ("problem", [small([line("1. 다음", 102, 100), line("7. 오인", 102, 250), line("2. 함수", 102, 400)])], ["1-1", "1-2"]),
    "choices": ("problem", [choices(1), choices(2)], run(1, 4)),
    "sparse": ("problem", [three(("1. 문제", 102, 100)), three(), three(("2. 문제", 102, 100))], ["1-1", *(f"1-{n}*" for n in range(2, 10))]),
    "overrun": ("problem", [ends(("1. 문제", 102, 100)), ends(), later(("3. 문제", 102, 100), ("4. 문제", 102, 400)), later(("5. 문제", 102, 100), ("6. 문제", 102, 400))], ["1-1", "1-2*", "1-3", "1-4", "1-5", "1-6"]),
    "labels": ("problem", [labels()], ["예제 1-1", "유제 1-1", "예제 1-2", "유제 1-2", "예제 1-3", "유제 1-3"]),
    "compound labels": ("problem", [problems(("유제 1-1", "유제 1-2", "유제 1-3"), ("유제 2-1", "유제 2-2"))], ["유제 1-1", "유제 1-2", "유제 1-3", "유제 2-1", "유제 2-2"]),
    "mixed labels": ("problem", [problems(("예제 1", 1, 2), ("예제 2", 3, 4)), problems(("예제 3", 5, 6), (7, 8))], ["예제 1-1", "1-1", "1-2", "예제 1-2", "1-3", "1-4", "예제 1-3", *run(5, 8)]),
    "column tops": ("problem", [problems((1, 2), (3, 4), 122), problems((5,), (1, 2), 122), problems((3, 4), (5, 6), 122)], [*run(1, 5), *run(1, 6, 2)]),
    "restart": ("problem", restart(), [*run(1, 8), "2-1*", "2-2*", *run(3, 8, 2)]),
    "two sections": ("problem", [*section(1), *section(1)], [*run(1, 8), *run(1, 8, 2)]),
    "concept page": ("problem", [*section(1), concept(), concept(), *section(1)], [*run(1, 8), *run(1, 8, 2)]),
    "trailing prose": ("problem", [*section(1), concept(), concept()], run(1, 8)),
    "unread numbers": ("problem", [*section(1), problems((9, 10), (11, 12), read=False)], [*run(1, 8), *(f"1-{n}*" for n in range(9, 13))]),
    "no numbers": ("problem", [problems((1, 2), (3, 4), read=False)], [f"1-{n}*" for n in range(1, 5)]),
    "quantity": ("solution", [quantities("2 이상의 자연수 n에 대하여")], run(1, 4)),
    "two quantities": ("solution", [quantities("1 이상 3 이하인 정수는", "2 개이므로 조건을 만족")], run(1, 4)),
    "restart behind a quantity": ("solution", [quantities("3 이하의 자연수 k에 대하여"), quantities()], [*run(1, 4), *run(1, 4, 2)]),
    "openings": ("problem", [problems((1,), (4,)), problems((5,), (6,))], ["1-1", "1-4", "1-5", "1-6"]),
    "solutions go on": ("solution", solutions(), run(1, 8)),
    "a full column": ("problem", [full(), headed()], run(1, 10)),
}


@pytest.fixture(scope="module")
def found(spark):
    rows = []
    for name, (kind, pages, _) in BOOKS.items():
        for n, p in enumerate(pages):
            rows.append((name, kind, n + 1, p["width"], p["height"], [{"x0": a, "x1": b} for a, b in p["columns"]], p["lines"], p["starts"], p["bottoms"]))
    got = segment.segment_pages(spark.createDataFrame(rows, segment.PAGES)).collect()
    books = {name: [] for name in BOOKS}
    for r in got:
        books[r.book_id].append(r)
    for rows in books.values():
        rows.sort(key=lambda r: (r.fragments[0].page, r.fragments[0].x0, r.fragments[0].y0))
    return books


def keys(items):
    return [f"{r.label + ' ' if r.label else ''}{r.section}-{r.number}{'*' if r.inferred else ''}" for r in items]


@pytest.mark.parametrize("name", list(BOOKS))
def test_items(found, name):
    assert keys(found[name]) == BOOKS[name][2]


def test_fragments(found):
    six = next(r for r in found["solutions go on"] if r.number == 6)
    assert [(f.page, f.cont) for f in six.fragments] == [(1, False), (2, True)]
    assert all(len(r.fragments) == 1 for r in found["a full column"])
    assert {r.ocr_number for r in found["sparse"]} == {None, 2}
    assert all(0 <= r.confidence <= 1 for rows in found.values() for r in rows)


def test_skips():
    marks = lambda: [segment.Mark(1, 0, 1, 500.0, 1000.0, n, "plain", 0.78, None, None, x, float(y), y + 22.0, 22.0, s, True, False, 0, visual=True) for n, x, y, s in ((1, 0.004, 100, 1.35), (5, 0.3, 400, 1.1), (20, 0.004, 800, 1.35))]
    assert [m.num for m in segment.select_marks(marks(), 3)] == [1, 20] and [m.num for m in segment.select_marks(marks(), 5)] == [1, 5, 20]


def test_runs_far_apart_are_kept():
    marks = [segment.Mark(p, 0, 1, 500.0, 1000.0, n, "plain", 0.78, None, None, 0.01, float(y), y + 20.0, 20.0, 1.2, True, False, 0) for p, n, y in ((1, 1, 100), (1, 2, 300), (50, 40, 100), (50, 41, 300), (100, 1, 100), (100, 2, 300))]
    assert len(segment.select_marks(marks)) == 6


def test_a_book_of_unread_pages():
    starts = [{**start(y, col=c), "h": 7.0, "cut_y": y - 40.0} for c in (0, 1) for y in (110, 430, 760)]
    pages = {n: {"width": 1000.0, "height": 1200.0, "columns": [(50.0, 480.0), (520.0, 950.0)], "lines": [], "starts": starts, "ink_bottoms": []} for n in range(1, 131)}
    read = [segment.Mark(20 * k + 1, 0, 2, 430.0, 1200.0, k + 1, "plain", 0.78, None, None, 0.004, 110.0, 128.0, 18.0, 1.5, True, True, 0, visual=True) for k in range(7)]
    began = time.time()
    got = segment.items_of(read, pages, "problem", top=0.05, bottom=0.05)
    assert time.time() - began < 5  # well under a second on an idle machine
    assert len(got) >= 700 and sum(m.inferred for m in got) >= 690
    assert max(m.fragments[0][4] - m.fragments[0][2] for m in got) < 0.45 * 1200


def canvas(w, h, *boxes):
    img = np.full((h, w), 255, np.uint8)
    for x, y, bw, bh, *shade in boxes:
        img[y : y + bh, x : x + bw] = shade[0] if shade else 20
    return img


@pytest.mark.parametrize(
    "boxes,want",
    [
        ([(0, 50, 1, 400), (100, 120, 120, 100)], (92, 112, 228, 228)),
        ([(0, 0, 500, 3), (496, 0, 4, 500), (0, 497, 500, 3), (150, 200, 90, 40)], (142, 192, 248, 248)),
        ([(4, 60, 1, 300), (4, 60, 480, 1), (4, 359, 480, 1), (483, 60, 1, 300), (30, 90, 300, 20), (30, 300, 400, 20)], (0, 52, 492, 368)),
        ([(0, 0, 2, 500)], None),
        ([(100, 120, 120, 100), (499, 10, 1, 1), (3, 480, 1, 1)], (92, 112, 228, 228)),
    ],
)
def test_trimming(boxes, want):
    assert raster.trim_box(canvas(500, 500, *boxes), (0, 0, 500, 500), 8) == want


def strokes(img, rng, x0, x1, y, h, share):
    for x in range(x0, x1):
        if rng.random() < share:
            img[y : y + h, x] = 20


def test_columns():
    rng = np.random.default_rng(7)
    aside = canvas(1190, 1684)
    for x0 in (82, 662):
        for y in range(150, 1500, 40):
            strokes(aside, rng, x0, x0 + 272, y, 8, 0.2)
    cols = raster.detect_columns(aside)
    assert len(cols) == 2 and cols[0][1] <= 400 and cols[1][0] >= 600
    few = canvas(1190, 1684)
    for x in (130, 330, 530):
        strokes(few, rng, x, x + 60, 300, 10, 0.3)
    cols = raster.detect_columns(few)
    assert len(cols) == 1 and cols[0][0] <= 140 and cols[0][1] >= 580
    dense, photo = canvas(1190, 1684), canvas(1190, 1684)
    for x0, x1 in ((81, 553), (621, 1102)):
        for y in range(150, 1500, 30):
            strokes(dense, rng, x0, x1, y, 16, 0.6)
            strokes(photo, rng, x0, x1, y, 14, 0.5)
    cols = raster.detect_columns(dense)
    assert len(cols) == 2 and all(abs(a - b) <= 3 for a, b in zip([*cols[0], *cols[1]], (81, 553, 621, 1102)))
    photo[700:960, 300:900] = 120
    cols = raster.detect_columns(photo)
    assert len(cols) == 2 and cols[0][1] <= 600 and cols[1][0] >= 580
    ruled = canvas(1190, 1684)
    for x0, x1 in ((90, 560), (630, 1100)):
        for y in range(150, 1500, 34):
            strokes(ruled, rng, x0, x1, y, 12, 0.4)
    ruled[200:1400, 594:597] = 20  # a thin rule between the columns
    assert len(raster.detect_columns(ruled)) == 2
    assert raster.detect_columns(canvas(400, 400)) == [(0.0, 400.0)]


def test_pictures():
    img = canvas(300, 200, (20, 30, 50, 40))
    assert raster.downscale(img) is img and raster.downscale(canvas(3200, 100)).shape == (50, 1600)
    assert raster.resize(np.array([[0, 100], [200, 100]], np.uint8), 1, 1).tolist() == [[100]]
    big = raster.stitch([np.full((9000, 2000), 7, np.uint8)] * 2)
    assert max(big.shape) <= 16_000 and big.size <= 16_000_000 and int(big[0, 0]) == 7
    got = raster.trim_fragments({1: canvas(500, 500, (100, 120, 120, 100))}, [{"page": 1, "x0": 0, "y0": 0, "x1": 500, "y1": 500}, {"page": 1, "x0": 0, "y0": 300, "x1": 500, "y1": 400, "cont": True}, {"page": 9, "x0": 0, "y0": 0, "x1": 9, "y1": 9}])
    assert [(f["x0"], f["y0"], f["x1"], f["y1"]) for f in got] == [(92.0, 112.0, 228.0, 228.0)]


def test_png_is_read_by_spark(spark, tmp_path):
    img = canvas(30, 20, (5, 5, 9, 4))
    (tmp_path / "a.png").write_bytes(raster.png(img))
    row = spark.read.format("image").load(str(tmp_path)).first().image
    assert (raster.luminance(row.data, row.height, row.width, row.nChannels) == img).all()
