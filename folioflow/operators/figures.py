"""Figures of lines and circles: found as geometry, accepted only where pixels support it."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflow.operators.image import blurred, components, decode_png, dilated, grey, saturation_hue

LEAST_SUPPORT = 0.82
LEAST_CIRCLE_SUPPORT = 0.62
REASON_MAP = "地图几何或标签未通过原图像素支撑校验"
REASON_GRID = "方格配图未通过 2×10 网格结构校验"

Segment = tuple[int, int, int, int]


def ink_of(image: np.ndarray) -> np.ndarray:
    """Dark pixels after evening the light, without red."""
    g = grey(image).astype(float)
    even = g - blurred(g, 25) + 235
    sat, hue = saturation_hue(image)
    return (even < 205) & ~((sat > 65) & ((hue < 15) | (hue > 168)))


def _runs(line: np.ndarray, least: int, gap: int) -> list[tuple[int, int]]:
    """Runs of True no further apart than `gap` and at least `least` long, ends included."""
    at = np.flatnonzero(line)
    if not len(at):
        return []
    cut = np.flatnonzero(np.diff(at) > gap + 1)
    return [(int(a), int(b)) for a, b in zip(at[np.r_[0, cut + 1]], at[np.r_[cut, len(at) - 1]], strict=True) if b - a + 1 >= least]


def merge_segments(found: list[tuple[int, int, int]], near: int = 6, gap: int = 18) -> list[tuple[int, int, int]]:
    """(coordinate, start, end) with close coordinates and touching spans as one, at its median coordinate."""
    out: list[tuple[int, int, int]] = []
    for group in clusters(sorted(found), near):
        spans = sorted((s, e) for _, s, e in group)
        joined = [list(spans[0])]
        for s, e in spans[1:]:
            if s <= joined[-1][1] + gap:
                joined[-1][1] = max(joined[-1][1], e)
            else:
                joined.append([s, e])
        out += [(int(np.median([c for c, _, _ in group])), s, e) for s, e in joined]
    return sorted(out)


def clusters(values: list, tolerance: int) -> list[list]:
    """Sorted values (or tuples led by one) in groups whose steps don't exceed the tolerance."""
    lead = lambda v: v[0] if isinstance(v, tuple) else v
    out: list[list] = []
    for v in values:
        if out and lead(v) - lead(out[-1][-1]) <= tolerance:
            out[-1].append(v)
        else:
            out.append([v])
    return out


def axis_segments(ink: np.ndarray, across: float = 0.18, down: float = 0.14) -> tuple[list[Segment], list[Segment]]:
    """Horizontal and vertical lines of at least a share of the width or height."""
    h, w = ink.shape
    rows = merge_segments([(y, a, b) for y in range(h) for a, b in _runs(ink[y], round(w * across), 3)])
    cols = merge_segments([(x, a, b) for x in range(w) for a, b in _runs(ink[:, x], round(h * down), 3)])
    return [(a, y, b, y) for y, a, b in rows], [(x, a, x, b) for x, a, b in cols]


def snapped(horizontal: list[Segment], vertical: list[Segment], tolerance: int) -> tuple[list[Segment], list[Segment]]:
    """Ends moved to the crossing direction's next coordinate within the tolerance."""
    xs, ys = sorted({v[0] for v in vertical}), sorted({h[1] for h in horizontal})
    to = lambda v, grid: min(grid, key=lambda g: (abs(g - v), g)) if grid and min(abs(g - v) for g in grid) <= tolerance else v
    return [(to(a, xs), y, to(b, xs), y) for a, y, b, _ in horizontal], [(x, to(a, ys), x, to(b, ys)) for x, a, _, b in vertical]


def line_mask(shape: tuple[int, int], segments: list[Segment], thick: int = 4) -> np.ndarray:
    out, r = np.zeros(shape, bool), thick // 2
    for x0, y0, x1, y1 in segments:
        out[max(0, min(y0, y1) - r) : max(y0, y1) + r, max(0, min(x0, x1) - r) : max(x0, x1) + r] = True
    return out


def support(mask: np.ndarray, ink: np.ndarray, reach: int = 3) -> float:
    """Share of a drawn mask that has ink near it."""
    n = int(mask.sum())
    return float((mask & dilated(ink, reach)).sum() / n) if n else 0.0


def interior_regions(boundary: np.ndarray, least: float = 0.004) -> tuple[np.ndarray, dict[int, tuple[int, int, int, int, int]]]:
    """Regions that the boundary closes off from the border, with their boxes and areas."""
    labels, stats = components(~boundary)
    h, w = boundary.shape
    inside = {i + 1: tuple(map(int, s)) for i, s in enumerate(stats) if s[0] > 0 and s[1] > 0 and s[2] < w and s[3] < h and s[4] >= h * w * least}
    return labels, inside


def adjacency(labels: np.ndarray, names: dict[int, str], horizontal: list[Segment], vertical: list[Segment], offset: int = 9) -> list[tuple[str, str]]:
    """Pairs of named regions that face each other across enough pixels of a line."""
    h, w = labels.shape
    faces: list[np.ndarray] = []
    for x0, y, x1, _ in horizontal:
        xs = np.arange(min(x0, x1) + offset, max(x0, x1) - offset + 1)
        if len(xs) >= 5 and offset <= y < h - offset:
            faces.append(np.stack([labels[y - offset, xs], labels[y + offset, xs]], 1))
    for x, y0, _, y1 in vertical:
        ys = np.arange(min(y0, y1) + offset, max(y0, y1) - offset + 1)
        if len(ys) >= 5 and offset <= x < w - offset:
            faces.append(np.stack([labels[ys, x - offset], labels[ys, x + offset]], 1))
    counts: dict[tuple[str, str], int] = {}
    for (a, b), n in zip(*np.unique(np.concatenate(faces), axis=0, return_counts=True), strict=True) if faces else ():
        if a != b and int(a) in names and int(b) in names:
            pair = tuple(sorted((names[int(a)], names[int(b)])))
            counts[pair] = counts.get(pair, 0) + int(n)
    return sorted(p for p, n in counts.items() if n >= max(8, offset))


def colourings(names: list[str], edges: list[tuple[str, str]], colours: int) -> int:
    """How many ways to colour the regions so that neighbours differ."""
    near = {n: [b if a == n else a for a, b in edges if n in (a, b)] for n in names}

    def ways(i: int, given: dict[str, int]) -> int:
        if i == len(names):
            return 1
        return sum(ways(i + 1, given | {names[i]: c}) for c in range(colours) if all(given.get(m) != c for m in near[names[i]]))

    return ways(0, {})


def map_figure(image: np.ndarray, expected: list[str], labels_at: dict[str, tuple[int, int]]) -> dict:
    """A map's regions, names and borders; one missing name goes to the one region without a name."""
    ink = ink_of(image)
    horizontal, vertical = snapped(*axis_segments(ink), 42)
    boundary = line_mask(ink.shape, horizontal + vertical)
    labels, regions = interior_regions(boundary)
    named: dict[int, str] = {}
    for name in expected:
        x, y = labels_at.get(name, (-1, -1))
        if 0 <= y < labels.shape[0] and 0 <= x < labels.shape[1] and (k := int(labels[y, x])) in regions and k not in named:
            named[k] = name
    read = list(named.values())
    names_left, regions_left = [n for n in expected if n not in read], [k for k in regions if k not in named]
    inferred = names_left if len(names_left) == 1 and len(regions_left) == 1 else []
    if inferred:
        named[regions_left[0]] = inferred[0]
    edges = adjacency(labels, named, horizontal, vertical)
    return {"kind": "five_country_map", "n_horizontal": len(horizontal), "n_vertical": len(vertical), "n_regions": len(regions), "n_expected": len(expected), "n_named": len(named), "n_inferred": len(inferred), "line_support": round(support(boundary, ink), 4), "edges": [list(e) for e in edges]}


def best_circles(found: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Of candidate circles x, y, r the three that overlap most evenly: one above two."""
    best = (np.inf, [])
    for group in combinations(found[:40], 3):
        c, r = np.array([g[:2] for g in group], float), np.array([g[2] for g in group], float)
        far = [float(np.hypot(*(c[a] - c[b]))) for a, b in ((0, 1), (0, 2), (1, 2))]
        top, *low = c[np.argsort(c[:, 1], kind="stable")]
        low = np.array(low)
        if np.ptp(r) > r.mean() * 0.25 or min(far) < r.mean() * 0.55 or max(far) > r.mean() * 1.8 or low[:, 1].mean() - top[1] < r.mean() * 0.45:
            continue
        score = r.std() * 2 + abs(low[0, 1] - low[1, 1]) + abs(low[:, 0].mean() - top[0])
        if score < best[0]:
            best = (score, list(group))
    return best[1]


def vote_circles(ink: np.ndarray, radii: range, most: int = 30, step: int = 2) -> list[tuple[int, int, int]]:
    """Circles by votes of ink pixels for centres at each radius; the strongest first, near doubles left out."""
    ys, xs = np.nonzero(ink)
    if not len(ys):
        return []
    turn = np.linspace(0, 2 * np.pi, 72, endpoint=False)
    h, w = ink.shape
    found: list[tuple[float, int, int, int]] = []
    for r in radii:
        cx = np.rint((xs[:, None] - r * np.cos(turn)) / step).astype(int).ravel()
        cy = np.rint((ys[:, None] - r * np.sin(turn)) / step).astype(int).ravel()
        ok = (cx >= 0) & (cy >= 0) & (cx < w // step + 1) & (cy < h // step + 1)
        n = np.bincount(cy[ok] * (w // step + 1) + cx[ok], minlength=(h // step + 1) * (w // step + 1))
        for k in np.argsort(n)[::-1][:8]:
            found.append((float(n[k]) / r, int(k % (w // step + 1)) * step, int(k // (w // step + 1)) * step, r))
    out: list[tuple[int, int, int]] = []
    for _, x, y, r in sorted(found, reverse=True):
        if all(np.hypot(x - a, y - b) > 0.3 * r for a, b, _ in out):
            out.append((x, y, r))
    return out[:most]


def circle_mask(shape: tuple[int, int], circles: list[tuple[int, int, int]], thick: int = 4) -> np.ndarray:
    y, x = np.mgrid[: shape[0], : shape[1]]
    out = np.zeros(shape, bool)
    for cx, cy, r in circles:
        out |= np.abs(np.hypot(x - cx, y - cy) - r) <= thick / 2
    return out


def circles_figure(image: np.ndarray, radii: range | None = None) -> dict:
    ink = ink_of(image)
    side = min(ink.shape)
    circles = best_circles(vote_circles(ink, radii or range(side // 8, side // 3, max(1, side // 60))))
    mask = circle_mask(ink.shape, circles)
    _, regions = interior_regions(mask, 0.0005)
    return {"kind": "three_overlapping_circles", "n_circles": len(circles), "n_regions": len(regions), "line_support": round(support(mask, ink, 4), 4), "circles": [list(c) for c in circles]}


def grid_figure(image: np.ndarray, rows: int = 2, columns: int = 10) -> dict:
    """A grid's lines; of more vertical lines than expected those nearest to even spacing count."""
    ink = ink_of(image)
    horizontal, vertical = axis_segments(ink, 0.45, 0.14)
    ys = sorted({h[1] for h in horizontal})
    if len(ys) > rows:
        y0, y1 = ys[0], ys[-1]
        vertical = [v for v in vertical if min(v[3], y1) - max(v[1], y0) >= (y1 - y0) * 0.45]
        xs = [int(np.median(g)) for g in clusters(sorted(v[0] for v in vertical), 7)]
        if len(xs) > columns:
            want, chosen = np.linspace(xs[0], xs[-1], columns + 1), []
            for t in want:
                x = min((x for x in xs if x not in chosen), key=lambda x: abs(x - t))
                if abs(x - t) <= max(28, (xs[-1] - xs[0]) / 30):
                    chosen.append(x)
            if len(chosen) == columns + 1:
                vertical = [(x, y0, x, y1) for x in sorted(chosen)]
                horizontal = [(xs[0], y, xs[-1], y) for y in ys[: rows + 1]]
        horizontal, vertical = snapped(horizontal, vertical, 10)
    return {"kind": "grid_2x10", "n_horizontal": len(horizontal), "n_vertical": len(vertical), "line_support": round(support(line_mask(ink.shape, horizontal + vertical), ink), 4)}


def reconstruct(image: np.ndarray, kind: str, **given) -> dict:
    """By kind; an unknown kind has nothing to find."""
    make = {"five_country_map": map_figure, "three_overlapping_circles": circles_figure, "grid_2x10": grid_figure}.get(kind)
    return make(image, **given) if make else {"kind": kind}


MEASURES = "kind string, n_horizontal int, n_vertical int, n_regions int, n_expected int, n_named int, n_inferred int, n_circles int, line_support double, edges array<array<string>>"


def passed() -> Column:
    """Whether a reconstruction's measures let it stand for the picture."""
    c = lambda n: F.coalesce(F.col(n), F.lit(0))
    of_map = (c("n_horizontal") >= 5) & (c("n_vertical") >= 3) & (c("n_expected") >= 3) & (c("n_regions") == c("n_expected")) & (c("n_named") == c("n_expected")) & (c("n_inferred") <= 1) & (c("line_support") >= LEAST_SUPPORT) & (F.size(F.coalesce("edges", F.array().cast("array<array<string>>"))) >= c("n_expected"))
    of_circles = (c("n_circles") == 3) & (c("n_regions") == 7) & (c("line_support") >= LEAST_CIRCLE_SUPPORT)
    of_grid = (c("n_horizontal") == 3) & (c("n_vertical") == 11) & (c("line_support") >= LEAST_SUPPORT)
    k = F.col("kind")
    return F.when(k == "five_country_map", of_map).when(k == "three_overlapping_circles", of_circles).when(k == "grid_2x10", of_grid).otherwise(F.lit(False))


def locate_figure(image: np.ndarray, below: int = 0) -> tuple[int, int, int, int] | None:
    """The box of the largest group of close ink parts below a line."""
    ink = ink_of(image)
    ink[:below] = False
    _, s = components(dilated(ink, 6))
    if not len(s):
        return None
    k = ((s[:, 2] - s[:, 0]) * (s[:, 3] - s[:, 1])).argmax()
    return tuple(map(int, s[k, :4]))


def distance_to(mask: np.ndarray) -> np.ndarray:
    """City-block distance to the mask, in two passes along each axis."""
    far = mask.shape[0] + mask.shape[1]
    d = np.where(mask, 0, far).astype(int)
    for axis in (0, 1):
        n = np.arange(d.shape[axis]).reshape((-1, 1) if axis == 0 else (1, -1))
        forward = np.minimum.accumulate(d - n, axis) + n
        back = np.flip(np.minimum.accumulate(np.flip(d + n, axis), axis), axis) - n
        d = np.minimum(forward, back)
    return d


def fidelity(original: np.ndarray, rebuilt: np.ndarray, reach: int = 3) -> dict:
    """How well two figures' lines agree: recall, precision, mean distance, parts and holes; `same` by the gates."""
    a, b = ink_of(original), ink_of(rebuilt)
    if not a.any() or not b.any():
        return {"recall": 0.0, "precision": 0.0, "chamfer": float("inf"), "same": bool(a.any() == b.any())}
    to_a, to_b = distance_to(a), distance_to(b)
    recall, precision = float((to_b[a] <= reach).mean()), float((to_a[b] <= reach).mean())
    chamfer = float((to_b[a].mean() + to_a[b].mean()) / 2)
    parts = abs(len(components(a)[1]) - len(components(b)[1]))
    return {"recall": recall, "precision": precision, "chamfer": chamfer, "parts_delta": parts, "same": recall >= 0.88 and precision >= 0.82 and chamfer <= 2.8}


def reconstruct_images(df: DataFrame, key: str, content: str, decoder: Callable[[bytes], np.ndarray] = decode_png) -> DataFrame:
    """`key`, the measures of each figure by its `kind`, and `error`.

    `df` has `kind`, `expected` array<string> and `places` map<string,array<int>>
    (a map's names and where they were read; null for other kinds). `passed`
    says which measures let a figure stand.
    """
    names = [f.split()[0] for f in MEASURES.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for r in batch.to_dict("records"):
                try:
                    given = {"expected": list(r["expected"]), "labels_at": {k: tuple(v) for k, v in dict(r["places"]).items()}} if r["kind"] == "five_country_map" else {}
                    out.append({key: r[key], **dict.fromkeys(names), **reconstruct(decoder(bytes(r[content])), r["kind"], **given), "error": None})
                except Exception as e:  # noqa: BLE001 - a bad picture must not fail the others
                    out.append({key: r[key], **dict.fromkeys(names), "kind": r["kind"], "error": f"{type(e).__name__}: {e}"})
            yield pd.DataFrame(out, columns=[key, *names, "error"])

    return df.select(key, content, "kind", "expected", "places").mapInPandas(run, f"{key} {df.schema[key].dataType.simpleString()}, {MEASURES}, error string")
