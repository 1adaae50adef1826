"""Page rasters as NumPy arrays: ink, columns, block starts, trimming and encoding choice.

Arrays are luminance (height, width), uint8; luminance() makes them of Spark's image rows (BGR).
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def luminance(data: bytes, height: int, width: int, channels: int) -> np.ndarray:
    x = np.frombuffer(data, np.uint8).reshape(height, width, channels)
    if channels == 1:
        return x[:, :, 0]
    b, g, r = (x[:, :, k].astype(np.uint32) for k in range(3))
    return ((299 * r + 587 * g + 114 * b) // 1000).astype(np.uint8)


def _up(x: float) -> int:
    """Rounded with halves up."""
    return int(np.floor(x + 0.5))


def ink_threshold(img: np.ndarray, samples: int = 20_000) -> int:
    """72 % luminance less 25, within 165..225, over a sampled grid."""
    step = max(4, int(np.sqrt(img.size / samples)))
    s = np.sort(img[::step, ::step].ravel())
    return int(np.clip((int(s[int(len(s) * 0.72)]) if len(s) else 255) - 25, 165, 225))


def profiles(ink: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ink pixels of each column and row."""
    return ink.sum(0), ink.sum(1)


def ink_ratio(img: np.ndarray) -> float:
    return float((img < ink_threshold(img)).mean()) if img.size else 0.0


def _runs(mask: np.ndarray) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate(([0], mask.astype(np.int8), [0]))))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist()))


def _body(h: int, top: float, bottom: float) -> tuple[int, int]:
    return int(h * top), int(h * (1 - bottom))


def without_long_runs(ink: np.ndarray, least: int) -> np.ndarray:
    """Ink without horizontal runs that long: photographs, shaded areas, rules."""
    edges = np.diff(np.pad(ink.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    (row, start), (_, end) = np.nonzero(edges > 0), np.nonzero(edges < 0)
    out = ink.copy()
    for r, a, b in zip(row, start, end):
        if b - a >= least:
            out[r, a:b] = False
    return out


def _pale_rows(rows: np.ndarray, ink: np.ndarray, threshold: int, least: int) -> np.ndarray:
    """Rows of pale blocks: even the darkest tenth of their ink is near the threshold, over at least so many rows."""
    dark, pale = ink.sum(1), np.zeros(len(rows), bool)
    for r in np.flatnonzero(dark > 0.03 * rows.shape[1]):
        core = np.sort(rows[r][ink[r]])[max(0, int(np.ceil(dark[r] * 0.1)) - 1)]
        pale[r] = core > threshold - 35
    for a, b in _runs(pale):
        if b - a < least:
            pale[a:b] = False
    return pale


def detect_columns(img: np.ndarray, top: float = 0.07, bottom: float = 0.06, most: int = 3) -> list[tuple[float, float]]:
    """One to three text columns, from the ink above each x: dark strokes only, every other row, without long runs and pale blocks."""
    h, w = img.shape
    lo, hi = _body(h, top, bottom)
    rows, threshold = img[lo:hi:2], min(190, ink_threshold(img))
    dark = rows < threshold
    ink = without_long_runs(dark, max(40, _up(0.035 * w)))[~_pale_rows(rows, dark, threshold, int(np.ceil(max(40, 0.025 * h) / 2)))]
    return _columns(ink.sum(0).astype(np.int64), max(1, len(rows)), w, most)


def _columns(counts: np.ndarray, rows: int, w: int, most: int) -> list[tuple[float, float]]:
    low = max(1, 0.004 * rows)
    inked = np.flatnonzero(counts > low)
    if len(inked) < 2:
        return [(0.0, float(w))]
    left, right = int(inked[0]), int(inked[-1])
    blank = counts <= low
    for a, b in _runs(~blank):  # thin rules between columns are blank too
        if a > 0 and b < w and b - a <= max(2, _up(0.006 * w)) and counts[a:b].max() > 0.2 * rows:
            blank[a:b] = True
    # shares of the inked width, or of more than half of the page where little is printed
    width = max(right - left + 1, 0.55 * w)
    origin = max(0.0, min(w - width, (left + right) / 2 - width / 2))
    at = lambda share: origin + width * share
    least = max(0.008 * w, 0.012 * width)
    split = _centre_split(counts, blank, rows, left, right, width, at, low, least)
    if split is not None:
        return [(float(left), float(split[0])), (float(split[1]), float(right + 1))]
    gaps = [(a, b) for a, b in ((a + left, b + left) for a, b in _runs(blank[left : right + 1])) if b - a >= least and at(0.2) < (a + b) / 2 < at(0.8)]
    wide = [g for g in gaps if g[1] - g[0] >= max(least, 0.42 * max(b - a for a, b in gaps))]
    out, start = [], left
    for a, b in sorted(sorted(wide, key=lambda g: g[0] - g[1])[: most - 1]):
        if a - start >= 0.2 * width:
            out.append((float(start), float(a)))
            start = b
    if right + 1 - start >= 0.2 * width or not out:
        return [*out, (float(start), float(right + 1))]
    return [*out[:-1], (out[-1][0], float(right + 1))]


def _centre_split(counts, blank, rows, left, right, width, at, low, least) -> tuple[int, int] | None:
    """The blank valley around the emptiest place near the middle, if it parts two inked sides."""
    half, w = max(12, _up(0.025 * width)), len(counts)
    sums = np.concatenate(([0], np.cumsum(counts)))
    places = np.arange(_up(at(0.36)), int(at(0.64)) + 1)
    ink = sums[np.minimum(w, places + half + 1)] - sums[np.maximum(0, places - half)]
    best, score = -1, np.inf
    for x, value in zip(places.tolist(), ink.tolist()):
        if value < 0.98 * score or (value <= 1.02 * score and abs(x - at(0.5)) < abs(best - at(0.5))):
            best, score = x, value
    if best <= 0:
        return None
    a = b = best
    while a > left and blank[a - 1]:
        a -= 1
    b = best + 1
    while b <= right and blank[b]:
        b += 1
    sides = (counts[_up(at(0.08)) : max(0, a - half)] > low).any() and (counts[min(w, b + half) : _up(at(0.92))] > low).any()
    return (a, b) if sides and at(0.28) < a and b < at(0.72) and b - a >= least and score / (2 * half + 1) <= 0.02 * rows else None


def _median(values) -> float:
    values = sorted(values)
    return values[len(values) // 2] if values else 0


def block_starts(img: np.ndarray, columns: list[tuple[float, float]], top: float = 0.07, bottom: float = 0.06) -> list[dict]:
    """Starts of visual blocks: bands of ink behind a gap that is large for the column, with ink at its left; and each column's first band."""
    h, w = img.shape
    ink, out = img < ink_threshold(img), []
    lo, hi = _body(h, top, bottom)
    for c, (x0, x1) in enumerate(columns):
        width, a, b = max(1, x1 - x0), max(0, int(x0)), min(w, int(x1))
        rows = ink[lo:hi, a:b:2].sum(1)
        bands: list[list[int]] = []
        for y in np.flatnonzero(rows >= max(2, _up(0.0025 * width))).tolist():
            if bands and y - bands[-1][1] <= 3:
                bands[-1][1] = y
            else:
                bands.append([y, y])
        if not bands:
            continue
        bands = [[lo + s, lo + e + 1] for s, e in bands]
        gaps = [n[0] - p[1] for p, n in zip(bands, bands[1:])]
        usual = sorted(g for g in gaps if 1 < g < 0.035 * h)
        gap, band = _median(usual) or max(4, 0.005 * h), _median([e - s for s, e in bands]) or max(6, 0.008 * h)
        large = max(12, 0.013 * h, 2.4 * gap, 0.75 * band)
        left = ink[:, a : min(w, int(x0 + 0.28 * width)) : 2].sum(1)

        def has_left_ink(y: int) -> bool:
            return left[max(lo, y - 2) : int(np.ceil(min(hi, y + max(2.5 * band, 0.035 * h))))].sum() >= max(4, 0.35 * band)

        def start(s: int, e: int, cut: float, sure: float, **more) -> dict:
            inked = np.flatnonzero(ink[s:e, a : min(w, int(np.ceil(x1)))].sum(0) >= 2)
            return {"col": c, "y0": float(s), "y1": float(e), "cut_y": float(cut), "h": float(band), "ink_x0": float(a + inked[0]) if len(inked) else None, "confidence": sure, "top": False, "top_gap": False} | more

        first = bands[0][0]
        if has_left_ink(first):
            line = usual[int((len(usual) - 1) * 0.25)] if usual else gap
            apart = first - lo >= max(0.008 * h, 1.2 * line)
            out.append(start(*bands[0], lo, 0.48 if apart else 0.4, top=True, top_gap=apart))
        for (_, before), (s, e) in zip(bands, bands[1:]):
            if s - before >= large and has_left_ink(s):
                out.append(start(s, e, _up((before + s) / 2), min(0.78, 0.42 + (s - before) / h * 5)))
    return out


def ink_bottoms(img: np.ndarray, columns: list[tuple[float, float]], top: float = 0.07, bottom: float = 0.06) -> list[float | None]:
    """The end of the last inked row of each column."""
    h, w = img.shape
    lo, hi = _body(h, top, bottom)
    ink, out = img < ink_threshold(img), []
    for a, b in columns:
        rows = np.flatnonzero(ink[lo:hi, max(0, int(a)) : min(w, int(b)) : 2].sum(1) >= max(2, _up(0.0025 * (b - a))))
        out.append(float(lo + rows[-1] + 1) if len(rows) else None)
    return out


def trim_threshold(part: np.ndarray) -> int:
    """The border's median luminance less 15, within 170..230."""
    h, w = part.shape
    sx, sy = max(1, w // 100), max(1, h // 100)
    border = np.sort(np.concatenate((part[0, ::sx], part[-1, ::sx], part[::sy, 0], part[::sy, -1])))
    return int(np.clip(int(border[len(border) // 2]) - 15, 170, 230))


def frame_lines(ink: np.ndarray, pad: int, rounds: int = 3) -> tuple[np.ndarray, np.ndarray] | None:
    """Masks of columns and rows that are lines along an edge of the box, longer than the content between them; None if there is
    nothing but such lines. A frame as long as what it holds is content."""
    h, w = ink.shape
    far = lambda n: np.minimum(np.arange(n), np.arange(n)[::-1]) < max(8, _up(0.05 * n))
    cols = far(w) & (ink.sum(0) >= 0.6 * h)
    rows = far(h) & (ink.sum(1) >= 0.6 * w)
    some_cols, some_rows = np.flatnonzero(cols), np.flatnonzero(rows)
    span = lambda line: (np.flatnonzero(line)[0], np.flatnonzero(line)[-1])
    for _ in range(rounds if len(some_cols) or len(some_rows) else 0):
        rest = ink & ~rows[:, None] & ~cols[None, :]
        if not rest.any():
            return None
        (y0, y1), (x0, x1) = span(rest.any(1)), span(rest.any(0))
        before = cols.copy(), rows.copy()
        for x in some_cols:
            a, b = span(ink[:, x])
            cols[x] = max(y0 - a, b - y1) >= max(2 * pad, 0.08 * h)
        for y in some_rows:
            a, b = span(ink[y])
            rows[y] = max(x0 - a, b - x1) >= max(2 * pad, 0.08 * w)
        if (before[0] == cols).all() and (before[1] == rows).all():
            break
    return cols, rows


def _touching(ink: np.ndarray) -> np.ndarray:
    """Ink with other ink at most one row and two columns away."""
    p = np.pad(ink.astype(np.int8), ((1, 1), (2, 2)))
    h, w = ink.shape
    around = sum(p[1 + dy : 1 + dy + h, 2 + dx : 2 + dx + w] for dy in (-1, 0, 1) for dx in range(-2, 3) if dx or dy)
    return ink & (around > 0)


def trim_box(img: np.ndarray, box: tuple[float, float, float, float], pad: int | None = None) -> tuple[int, int, int, int] | None:
    """The box cut down to its ink, with a pad; None if nothing is left. Dust and edge lines don't count, thin axes do."""
    x0, y0, x1, y1 = max(0, int(np.floor(box[0]))), max(0, int(np.floor(box[1]))), min(img.shape[1], int(np.ceil(box[2]))), min(img.shape[0], int(np.ceil(box[3])))
    if x1 <= x0 or y1 <= y0:
        return None
    part = img[y0:y1, x0:x1]
    pad = max(8, _up(0.0045 * min(img.shape))) if pad is None else pad
    ink = part < trim_threshold(part)
    lines = frame_lines(ink, pad)
    if lines is None:
        return None
    ink = ink & ~lines[0][None, :] & ~lines[1][:, None]
    if not ink.any():
        return None
    h, w = part.shape
    cols, rows = ink.sum(0), ink.sum(1)
    dense_c, dense_r = cols >= max(2, _up(0.001 * h)), rows >= max(2, _up(0.0015 * w))
    if not dense_c.any() or not dense_r.any():
        ys, xs = np.nonzero(ink)
        return int(x0 + xs.min()), int(y0 + ys.min()), int(x0 + xs.max() + 1), int(y0 + ys.max() + 1)
    kept = (ink & dense_r[:, None] & dense_c[None, :]) | (_touching(ink) & (dense_r[:, None] ^ dense_c[None, :]))
    if kept.any():
        ys, xs = np.nonzero(kept)
    else:
        ys, xs = np.flatnonzero(dense_r), np.flatnonzero(dense_c)
    left, right, upper, lower = int(xs.min()), int(xs.max()), int(ys.min()), int(ys.max())
    while left <= right and left < 4 and cols[left] > 0.65 * h:
        left += 1
    while right >= left and w - 1 - right < 4 and cols[right] > 0.65 * h:
        right -= 1
    while upper <= lower and upper < 4 and rows[upper] > 0.65 * w:
        upper += 1
    while lower >= upper and h - 1 - lower < 4 and rows[lower] > 0.65 * w:
        lower -= 1
    return max(x0, x0 + left - pad), max(y0, y0 + upper - pad), min(x1, x0 + right + 1 + pad), min(y1, y0 + lower + 1 + pad)


def trim_fragments(pages: dict[int, np.ndarray], fragments: list[dict]) -> list[dict]:
    """Fragments cut down to their ink; empty ones go, those on pages that aren't there, and continuations of under 1.5 % of a page."""
    out = []
    for f in fragments:
        img = pages.get(f["page"])
        box = None if img is None else trim_box(img, (f["x0"], f["y0"], f["x1"], f["y1"]))
        if box is not None and not (f.get("cont") and box[3] - box[1] < 0.015 * img.shape[0]):
            out.append({"page": f["page"], **dict(zip(("x0", "y0", "x1", "y1"), map(float, box))), "cont": bool(f.get("cont"))})
    return out


def resize(img: np.ndarray, width: int, height: int) -> np.ndarray:
    """img at a smaller size, each new pixel the mean of what it covers (a larger size repeats pixels)."""
    for axis, n in ((0, height), (1, width)):
        m = img.shape[axis]
        if n != m:
            edges = (np.arange(n) * m / n).astype(np.int64)
            sums = np.add.reduceat(img.astype(np.float64), edges, axis=axis)
            count = np.diff(np.append(edges, m))
            shape = [-1 if k == axis else 1 for k in range(img.ndim)]
            img = sums / np.maximum(1, count).reshape(shape)
    return np.rint(img).astype(np.uint8)


def downscale(img: np.ndarray, widest: int = 1600) -> np.ndarray:
    """img as it is, or at the widest width that a model is sent."""
    h, w = img.shape[:2]
    return img if w <= widest else resize(img, widest, max(1, _up(h * widest / w)))


def encoding(img: np.ndarray, rgb: np.ndarray | None = None) -> str:
    """jpeg for photographs and textures, png for print."""
    step = max(1, int(np.sqrt(img.size / 50_000)))
    s = img[::step, ::step].astype(np.int32)
    midtone = float(((s > 40) & (s < 245)).mean())
    change = np.abs(np.diff(s, axis=1))
    texture = float(((change >= 3) & (change <= 48)).mean()) if change.size else 0.0
    tones = len(np.unique(s >> 3))
    colours = tones if rgb is None else len(np.unique((rgb[::step, ::step].astype(np.int32) >> 4) @ np.array([256, 16, 1])))
    return "jpeg" if midtone > 0.12 and texture > 0.12 and (colours > 96 or tones > 24) else "png"


def crop(pages: dict[int, np.ndarray], fragments: list[dict], gap: int = 8) -> tuple[np.ndarray, float] | None:
    """An item's picture, its fragments under one another, and the factor it was made smaller by; None without pages."""
    parts = [pages[f["page"]][int(f["y0"]) : int(f["y1"]), int(f["x0"]) : int(f["x1"])] for f in fragments if f["page"] in pages]
    parts = [p for p in parts if p.size]
    if not parts:
        return None
    out = stitch(parts, gap)
    return out, min(1.0, out.shape[0] / (sum(p.shape[0] for p in parts) + gap * (len(parts) - 1)))


def stitch(parts: list[np.ndarray], gap: int = 8, side: int = 16_000, area: int = 16_000_000) -> np.ndarray:
    """Crops under one another on white, made smaller as a whole where the picture would be too large."""
    w, h = max(p.shape[1] for p in parts), sum(p.shape[0] for p in parts) + gap * (len(parts) - 1)
    out, y = np.full((h, w), 255, np.uint8), 0
    for p in parts:
        out[y : y + p.shape[0], : p.shape[1]] = p
        y += p.shape[0] + gap
    k = min(1.0, side / max(w, h), np.sqrt(area / (w * h)))
    return out if k == 1 else resize(out, max(1, _up(w * k)), max(1, _up(h * k)))


LAYOUT = (
    "origin string, width int, height int, columns array<struct<x0:double,x1:double>>, ink_bottoms array<double>, format string, "
    "visual_starts array<struct<col:int,y0:double,y1:double,cut_y:double,h:double,ink_x0:double,confidence:double,top:boolean,top_gap:boolean>>"
)


def png(img: np.ndarray) -> bytes:
    """A grey picture as a PNG file."""
    h, w = img.shape
    part = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    rows = np.hstack([np.zeros((h, 1), np.uint8), img.astype(np.uint8)]).tobytes()
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 0, 0, 0, 0)) + part(b"IDAT", zlib.compress(rows, 6)) + part(b"IEND", b"")


def page_layout(images: DataFrame, keys: list[str] = (), top: float = 0.07, bottom: float = 0.06) -> DataFrame:
    """Layout of every row of Spark's image source (column image): columns, block starts, ink bottoms and encoding; keys are kept."""
    kinds = dict(images.dtypes)

    def run(batches):
        for pdf in batches:
            out = []
            for im in pdf["image"]:
                y = luminance(im["data"], im["height"], im["width"], im["nChannels"])
                rgb = np.frombuffer(im["data"], np.uint8).reshape(im["height"], im["width"], im["nChannels"])[:, :, 2::-1] if im["nChannels"] >= 3 else None
                cols = detect_columns(y, top, bottom)
                out.append((im["origin"], im["width"], im["height"], [{"x0": a, "x1": b} for a, b in cols], ink_bottoms(y, cols, top, bottom), encoding(y, rgb), block_starts(y, cols, top, bottom)))
            made = pd.DataFrame(out, columns=["origin", "width", "height", "columns", "ink_bottoms", "format", "visual_starts"])
            yield pd.concat([pdf[list(keys)].reset_index(drop=True), made], axis=1)

    ddl = "".join(f"`{k}` {kinds[k]}, " for k in keys)
    return images.select(*keys, "image").mapInPandas(run, ddl + LAYOUT)
