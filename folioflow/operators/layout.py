"""Page geometry: boxes, anchors, spans, clusters, reading order, page splits.

Boxes of recognised lines are normalised x, y, width, height from the bottom
left; pixel boxes are x0, y0, x1, y1 from the top left.
"""

from __future__ import annotations

import re
import statistics

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioflow.functions import text as T

# How printed questions begin, and what only looks like it.
EXAMPLE_ANCHOR = "(?iu)^\\s*[【\\[(（]?\\s*(例题|例|练习|预习)\\s*([0-9S]{1,3})"
MISREAD_ANCHOR = "^\\s*列\\s*([0-9S]{1,2})\\s*[、.．]"
NUMBERED_ANCHOR = "^\\s*([1-9][0-9]?)\\s*[、.．]"
NUMBER_LIST = "^\\s*[0-9]{1,3}\\s*[、.．]\\s*[0-9]{1,3}\\s*[、.．]"
SECTION_HEADING = "第.+部分|小试牛刀"
ANCHOR_LEFT = 0.24
LEAST_CONFIDENCE = 0.45


# ---- boxes


def pixel_box(box: Column, width: Column, height: Column) -> Column:
    """A line's box struct<x, y, w, h> in pixels, halves rounded to even, cut to the page."""
    px = lambda v: F.rint(v).cast("int")
    return F.struct(
        F.greatest(F.lit(0), px(box["x"] * width)).alias("x0"),
        F.greatest(F.lit(0), px((1 - box["y"] - box["h"]) * height)).alias("y0"),
        F.least(width.cast("int"), px((box["x"] + box["w"]) * width)).alias("x1"),
        F.least(height.cast("int"), px((1 - box["y"]) * height)).alias("y1"),
    )


def polygon_box(points: Column, width: Column, height: Column) -> Column:
    """The normalised box of array<struct<x, y>> pixel points from the top left."""
    low = lambda c, n: F.greatest(F.lit(0.0), F.least(n, F.array_min(F.transform(points, lambda p: p[c]))))
    high = lambda c, n: F.greatest(F.lit(0.0), F.least(n, F.array_max(F.transform(points, lambda p: p[c]))))
    w, h = width.cast("double"), height.cast("double")
    return F.struct((low("x", w) / w).alias("x"), (1 - high("y", h) / h).alias("y"), ((high("x", w) - low("x", w)) / w).alias("w"), ((high("y", h) - low("y", h)) / h).alias("h"))


def area(b: Column) -> Column:
    return F.greatest(F.lit(0), b["x1"] - b["x0"]) * F.greatest(F.lit(0), b["y1"] - b["y0"])


def intersection(a: Column, b: Column) -> Column:
    return F.greatest(F.lit(0), F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"])) * F.greatest(F.lit(0), F.least(a["y1"], b["y1"]) - F.greatest(a["y0"], b["y0"]))


def expanded(b: Column, pad: Column, width: Column, height: Column) -> Column:
    return F.struct(F.greatest(F.lit(0), b["x0"] - pad).alias("x0"), F.greatest(F.lit(0), b["y0"] - pad).alias("y0"), F.least(width, b["x1"] + pad).alias("x1"), F.least(height, b["y1"] + pad).alias("y1"))


def union_box(boxes: Column, pad_x: Column, pad_y: Column, width: Column, height: Column) -> Column:
    """The box around array<box> with padding, cut to the page; null for none."""
    side = lambda f, c: f(F.transform(boxes, lambda b: b[c]))
    return F.when(F.size(boxes) > 0, F.struct(F.greatest(F.lit(0), side(F.array_min, "x0") - pad_x).alias("x0"), F.greatest(F.lit(0), side(F.array_min, "y0") - pad_y).alias("y0"), F.least(width, side(F.array_max, "x1") + pad_x).alias("x1"), F.least(height, side(F.array_max, "y1") + pad_y).alias("y1")))


def question_box(lines: Column, width: Column, height: Column) -> Column:
    """The padded box of the lines from the first question start to the terminal; null if either lacks. Lines: array<struct<text, box>>."""
    starts = r"(?iu)(?:[【\[(（]?(?:例题|例|练习)\s*[0-9S]+|^\s*列\s*[0-9S]+\s*[、.．]|^\s*[1-9][0-9]?\s*[、.．])"
    first = F.array_position(F.transform(lines, lambda x: T.text_of(x["text"]).rlike(starts)), True)
    rest = F.slice(lines, F.greatest(first, F.lit(1)), F.greatest(F.size(lines), F.lit(1)))
    last = F.array_position(F.transform(rest, lambda x: T.has_terminal(x["text"])), True)
    boxes = F.transform(F.slice(rest, F.lit(1), last), lambda x: pixel_box(x["box"], width, height))
    pad = lambda least, share, n: F.greatest(F.lit(least), F.rint(n * share).cast("int"))
    return F.when((first > 0) & (last > 0), union_box(boxes, pad(12, 0.012, width), pad(8, 0.008, height), width, height))


def overlapping(lines: Column, boxes: Column) -> Column:
    """Per line its boxes of positive overlap; a theta join within one row, without a shuffle."""
    return F.transform(lines, lambda a: F.filter(boxes, lambda b: intersection(a, b) > 0))


def without_covered(boxes: Column, figures: Column, share: float = 0.25, least_area: int = 64) -> Column:
    """Boxes large enough that no figure covers more than a share of."""
    return F.filter(boxes, lambda b: (area(b) >= least_area) & ~F.exists(figures, lambda f: intersection(b, f) > area(b) * share))


def best_boxes(boxes: Column, most: int = 64) -> Column:
    """The highest scores, in order of place. Boxes have score, x0 and y0."""
    ranked = F.slice(F.array_sort(F.transform(boxes, lambda b, i: F.struct((-b["score"]).alias("s"), i.alias("i"), b.alias("b")))), 1, most)
    placed = F.array_sort(F.transform(ranked, lambda r: F.struct(r["b"]["y0"].alias("y"), r["b"]["x0"].alias("x"), r["i"].alias("i"), r["b"].alias("b"))))
    return F.transform(placed, lambda r: r["b"])


def nearest(value: Column, grid: Column, tolerance: Column) -> Column:
    """The grid value next to `value` within the tolerance (of two the smaller), else the value."""
    best = F.array_min(F.transform(grid, lambda g: F.struct(F.abs(g - value).alias("d"), g.alias("g"))))
    return F.when(best["d"] <= tolerance, best["g"]).otherwise(value)


def rotation_hint(lines: Column) -> Column:
    """-90 where boxes are on the whole taller than wide (weighted by text length, ratio under 1.2), else 0."""
    w = lambda x: F.greatest(F.lit(1), F.length(T.text_of(x["text"])))
    total = F.aggregate(lines, F.lit(0.0), lambda a, x: a + w(x))
    ratio = F.aggregate(lines, F.lit(0.0), lambda a, x: a + w(x) * x["box"]["w"] / F.greatest(x["box"]["h"], F.lit(1e-6))) / total
    return F.when((total > 0) & (ratio < 1.2), -90).otherwise(0)


def line_order(lines: Column) -> Column:
    """Lines from top to bottom, left to right."""
    return F.transform(F.array_sort(F.transform(lines, lambda x, i: F.struct((-x["box"]["y"]).alias("y"), x["box"]["x"].alias("x"), i.alias("i"), x.alias("l")))), lambda r: r["l"])


# ---- folds and windows


def far_from_last_kept(values: Column, gap: Column) -> Column:
    """Ascending values each at least `gap` after the last kept one: a fold, since lag would compare with dropped ones."""
    empty = F.array().cast("array<double>")
    return F.aggregate(F.array_sort(values), empty, lambda kept, v: F.when((F.size(kept) == 0) | (v - F.try_element_at(kept, F.lit(-1)) >= gap), F.concat(kept, F.array(v))).otherwise(kept))


def gap_clusters(df: DataFrame, by: list[str], value: str, tolerance: float) -> DataFrame:
    """`df` with `cluster`: a new number where the step from the previous value exceeds the tolerance."""
    w = Window.partitionBy(*by).orderBy(value)
    jump = F.coalesce(F.col(value) - F.lag(value).over(w) > tolerance, F.lit(False))
    return df.withColumn("cluster", F.sum(jump.cast("int")).over(w))


def merge_intervals(df: DataFrame, by: list[str], start: str, end: str, tolerance: float = 0) -> DataFrame:
    """`by`, `start`, `end` and `parts` of the unions of intervals no further apart than the tolerance."""
    w = Window.partitionBy(*by).orderBy(start, end)
    before = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = F.coalesce(F.col(start) > before + tolerance, F.lit(True)).cast("int")
    marked = df.withColumn("__n", new).withColumn("__i", F.sum("__n").over(w))
    return marked.groupBy(*by, "__i").agg(F.min(start).alias(start), F.max(end).alias(end), F.count("*").alias("parts")).drop("__i")


def spans(df: DataFrame, by: list[str], start: str, last: Column) -> DataFrame:
    """`df` with `span_end`: the next start, or `last` for the last one."""
    return df.withColumn("span_end", F.coalesce(F.lead(start).over(Window.partitionBy(*by).orderBy(start)), last))


# ---- anchors and page splits


def parse_anchor(text: Column) -> Column:
    """struct<label, kind, number> of a line that begins a question, or null."""
    t = F.trim(T.text_of(text))
    digits = lambda p, g: F.replace(F.upper(F.regexp_extract(t, p, g)), F.lit("S"), F.lit("5")).try_cast("int")
    word = F.regexp_extract(t, EXAMPLE_ANCHOR, 1)
    made = lambda prefix, n, suffix, kind: F.struct(F.concat(F.lit("【"), prefix, n.cast("string"), F.lit(suffix)).alias("label"), F.lit(kind).alias("kind"), n.alias("number"))
    return (
        F.when(t.rlike(EXAMPLE_ANCHOR), made(F.when(word.isin("练习", "预习"), word).otherwise("例题"), digits(EXAMPLE_ANCHOR, 2), "】", "example"))
        .when(t.rlike(MISREAD_ANCHOR), made(F.lit("例题"), digits(MISREAD_ANCHOR, 1), "】", "example"))
        .when(t.rlike(NUMBERED_ANCHOR) & ~t.rlike(NUMBER_LIST), made(F.lit("第"), digits(NUMBERED_ANCHOR, 1), "题】", "numbered"))
    )


ANCHOR = "struct<label:string,kind:string,number:int,raw_text:string,top:int,left:int,confidence:double>"


def anchors(lines: Column, width: Column, height: Column) -> Column:
    """The question anchors of a page's lines, top to bottom, as array<struct<label, kind, number, raw_text, top, left, confidence>>.

    One too near the last kept one is dropped; a two-digit number that follows
    example n with n + 1 in its last place is that example, misread.
    """
    found = F.filter(F.transform(lines, lambda x: F.struct(parse_anchor(x["text"]).alias("a"), F.trim(x["text"]).alias("t"), pixel_box(x["box"], width, height).alias("b"), x["confidence"].alias("c"))), lambda z: z["a"].isNotNull() & (z["b"]["x0"] <= width * ANCHOR_LEFT))
    ordered = F.array_sort(F.transform(found, lambda z, i: F.struct(z["b"]["y0"].alias("top"), z["b"]["x0"].alias("left"), i.alias("i"), z["a"].alias("a"), z["t"].alias("t"), z["c"].alias("c"))))
    gap = F.greatest(F.lit(25), F.rint(height * 0.018).cast("int"))

    def step(kept: Column, z: Column) -> Column:
        last = F.try_element_at(kept, F.lit(-1))
        some = F.size(kept) > 0
        near = some & (z["top"] - last["top"] < gap)
        misread = some & (z["a"]["kind"] == "numbered") & (z["a"]["number"] >= 10) & (last["kind"] == "example") & (z["a"]["number"] % 10 == last["number"] + 1)
        n = F.when(misread, z["a"]["number"] % 10).otherwise(z["a"]["number"])
        own = F.struct(F.when(misread, F.concat(F.lit("【例题"), n.cast("string"), F.lit("】"))).otherwise(z["a"]["label"]).alias("label"), F.when(misread, "example").otherwise(z["a"]["kind"]).alias("kind"), n.alias("number"), z["t"].alias("raw_text"), z["top"].alias("top"), z["left"].alias("left"), z["c"].cast("double").alias("confidence"))
        return F.when(near, kept).otherwise(F.concat(kept, F.array(own)))

    return F.aggregate(ordered, F.array().cast(f"array<{ANCHOR}>"), step)


def adjusted_starts(starts: Column, boxes: Column, height: Column) -> Column:
    """Region starts moved off formula boxes that they cut: to the nearest edge, not before the start above."""
    pad = F.greatest(F.lit(4), F.rint(height * 0.003).cast("int"))
    none = F.array().cast("array<int>")

    def step(done: Column, at: Column) -> Column:
        crossing = F.filter(boxes, lambda b: (b["y0"] < at) & (at < b["y1"]))
        above = F.try_element_at(done, F.lit(-1))
        edges = F.flatten(F.transform(crossing, lambda b: F.array(F.greatest(above + 1, b["y0"] - pad), F.least(height - 1, b["y1"] + pad))))
        best = F.array_min(F.transform(edges, lambda e, i: F.struct(F.abs(e - at).alias("d"), i.alias("i"), e.alias("e"))))["e"]
        return F.concat(done, F.array(F.when((F.size(done) == 0) | (F.size(crossing) == 0), at).otherwise(best)))

    return F.aggregate(starts, none, step)


# ---- reading order: each line joins the rows before it, so a page is folded in Python


_TERMINAL, _START = re.compile(T.QUESTION_TERMINAL), re.compile(T.QUESTION_START)
_ANCHORS = tuple(re.compile(p) for p in (EXAMPLE_ANCHOR, MISREAD_ANCHOR, NUMBERED_ANCHOR))


def reading_order(lines: list[dict]) -> str:
    """Lines (text, confidence, x, y, w, h) as the question's text, row by row.

    Rows are built greedily by vertical overlap without horizontal overlap. Close
    rows below the terminal's row belong before it.
    """
    rows: list[dict] = []
    for e in sorted(({**x, "top": 1 - x["y"] - x["h"], "low": 1 - x["y"], "right": x["x"] + x["w"]} for x in lines if (x["text"] or "").strip()), key=lambda e: (e["top"], e["x"])):
        best, most = None, 0.0
        for r in rows:
            vertical = max(0.0, min(e["low"], r["low"]) - max(e["top"], r["top"])) / max(0.001, min(e["low"] - e["top"], r["low"] - r["top"]))
            horizontal = max(0.0, min(e["right"], r["right"]) - max(e["x"], r["left"])) / max(0.001, min(max(0.001, e["right"] - e["x"]), r["right"] - r["left"]))
            if vertical >= 0.28 and horizontal < 0.18 and vertical > most:
                best, most = r, vertical
        if best is None:
            rows.append(best := {"items": [], "top": e["top"], "low": e["low"], "left": e["x"], "right": e["right"]})
        best["items"].append(e)
        best.update(top=min(best["top"], e["top"]), low=max(best["low"], e["low"]), left=min(best["left"], e["x"]), right=max(best["right"], e["right"]))
    for r in rows:
        r["base"] = statistics.median(i["y"] for i in r["items"])
        r["sure"] = max(i["confidence"] for i in r["items"])
        r["text"] = "".join(i["text"].strip() for i in sorted(r["items"], key=lambda i: i["x"]))
    rows.sort(key=lambda r: -r["base"])
    first = next((i for i, r in enumerate(rows) if _START.search(r["text"])), None)
    if first is None:
        return ""
    end = next((i for i in range(first, len(rows)) if _TERMINAL.search(rows[i]["text"])), None)
    if end is None:
        return "\n".join(r["text"] for r in rows[first:])
    stray = []
    for above, r in zip(rows[end:], rows[end + 1 :], strict=False):
        if above["base"] - r["base"] > 0.045 or r["sure"] < LEAST_CONFIDENCE:
            break
        stray.append(r)
    return "\n".join(r["text"] for r in [*rows[first:end], *stray, rows[end]])


def _columns(entries: list[dict]) -> list[list[dict]]:
    groups: list[list[dict]] = []
    for e in sorted(entries, key=lambda e: -e["y"]):
        g = groups[-1] if groups else []
        beside = g and abs(statistics.median(i["y"] for i in g) - e["y"]) <= 0.009 and not any(min(e["x"] + e["w"], i["x"] + i["w"]) - max(e["x"], i["x"]) > 0.01 for i in g)
        if beside:
            g.append(e)
        else:
            groups.append([e])
    return groups


def region_text(lines: list[dict], anchor: str, start: int, end: int, height: int) -> str:
    """The text of a page region that may have two columns; lines that span the page stand in their place."""
    inside = [x for x in lines if start <= (max(0, round((1 - x["y"] - x["h"]) * height)) + min(height, round((1 - x["y"]) * height))) // 2 < end]
    entries = []
    for x in inside:
        t = (x["text"] or "").strip()
        weak = x["confidence"] < LEAST_CONFIDENCE and t != anchor and not re.search("[？?]", t) and len(re.findall("[一-鿿]", t)) < 8
        if t and not weak and not re.search(SECTION_HEADING, t) and x["x"] >= 0.075:
            entries.append({**x, "text": t})
    narrow = [e for e in entries if e["w"] < 0.58]
    left, right = _columns([e for e in narrow if e["x"] < 0.4]), _columns([e for e in narrow if e["x"] >= 0.4])
    rows = [(e["y"], e["text"]) for e in entries if e["w"] >= 0.58]
    paired = []
    for i in range(max(len(left), len(right))):
        items = [*(left[i] if i < len(left) else []), *(right[i] if i < len(right) else [])]
        paired.append((statistics.median(e["y"] for e in items), "".join(e["text"] for e in sorted(items, key=lambda e: e["x"]))))
    texts = [t for _, t in sorted(paired + rows, key=lambda r: -r[0])]
    if not texts:
        return ""
    first = next((i for i, t in enumerate(texts) if anchor in t or any(p.search(t) for p in _ANCHORS)), None)
    if first is None:
        return reading_order(inside)
    out = []
    for t in texts[first:]:
        m = _TERMINAL.search(t)
        out.append(t[: m.end()] if m else t)
        if m:
            break
    return "\n".join(out)


def ordered_text(lines: DataFrame, by: str = "page_id") -> DataFrame:
    """`by` and `text` of each page; `lines` has text, confidence, x, y, w and h. A page is one group, of one page's lines."""

    def run(key, page: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({by: [key[0]], "text": [reading_order(page.to_dict("records"))]})

    return lines.groupBy(by).applyInPandas(run, f"{by} {lines.schema[by].dataType.simpleString()}, text string")


REGION = "label string, region_index int, start int, end int, anchor_text string, ocr_text string"


def split_pages(lines: DataFrame, found: DataFrame, by: str = "page_id") -> DataFrame:
    """Regions of the pages that hold several questions.

    `found` has `by`, height, `anchors` (as from `anchors`) and `starts` (as from
    `adjusted_starts`). Pages with fewer than two anchors, or with more than one
    region too small or without a question, give none.
    """

    def run(key, page: pd.DataFrame, info: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        for r in info.to_dict("records"):
            marks, starts, height = list(r["anchors"]), list(r["starts"]), r["height"]
            for i, a in enumerate(marks):
                start, end = starts[i], starts[i + 1] if i + 1 < len(starts) else height
                if end - start < height * 0.055:
                    continue
                text = region_text(page.to_dict("records"), a["raw_text"], start, end, height)
                if not _TERMINAL.search(text) and len(re.sub("[^一-鿿A-Za-z0-9]", "", text)) < 18:
                    continue
                out.append((key[0], a["label"], i + 1, int(start), int(end), a["raw_text"], text))
            if len(marks) < 2 or len(out) < max(2, len(marks) - 1):
                out = []
        return pd.DataFrame(out, columns=[by, "label", "region_index", "start", "end", "anchor_text", "ocr_text"])

    return lines.groupBy(by).cogroup(found.groupBy(by)).applyInPandas(run, f"{by} {lines.schema[by].dataType.simpleString()}, {REGION}")


def page_regions(pages: DataFrame, by: str = "page_id") -> DataFrame:
    """Regions of pages with `lines` array<struct<text, confidence, box>>, `width`, `height` and `formula_boxes` array<box>."""
    height = F.col("height")
    pad = F.greatest(F.lit(28), F.rint(height * 0.035).cast("int"))
    found = pages.withColumn("anchors", anchors(F.col("lines"), F.col("width"), height))
    starts = F.transform("anchors", lambda a: F.greatest(F.lit(0), a["top"] - pad))
    found = found.withColumn("starts", adjusted_starts(starts, F.coalesce("formula_boxes", F.array().cast("array<struct<x0:int,y0:int,x1:int,y1:int>>")), height))
    flat = pages.select(by, F.explode("lines").alias("l")).select(by, "l.text", "l.confidence", "l.box.x", "l.box.y", "l.box.w", "l.box.h")
    return split_pages(flat, found.select(by, "height", "anchors", "starts"), by)
