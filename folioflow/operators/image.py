"""Page images in numpy: orientation, straightening, background, mark removal, crops.

Pictures are uint8 arrays of height x width x 3 (blue, green, red). Kernels run
in `map_images` on Arrow batches and only measure; what follows from a measure
(gates, reasons) is a column expression over the metrics.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Gates and the reasons they give.
GATES = (("orientation_confidence", "<", 0.55, "方向判断置信度较低"), ("page_confidence", "<", 0.30, "未可靠检测到纸面边界"), ("protected_overlap_pixels", ">", 0, "清理区域与印刷内容保护区冲突"), ("removed_fraction", ">", 0.08, "清理面积异常偏大"))
LONGEST_SIDE = 2600
LONGEST_DETAIL = 4200


# ---- PNG without further libraries; other formats come from a provider's decoder


def decode_png(data: bytes) -> np.ndarray:
    """An 8-bit grey, RGB or RGBA picture that is not interlaced."""
    if data[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("not a PNG")
    at, body, head = 8, b"", None
    while at + 8 <= len(data):
        n, kind = struct.unpack(">I4s", data[at : at + 8])
        part, at = data[at + 8 : at + 8 + n], at + 12 + n
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", part)
        elif kind == b"IDAT":
            body += part
    width, height, depth, colour, _, _, interlaced = head or (0, 0, 0, 0, 0, 0, 1)
    planes = {0: 1, 2: 3, 6: 4}.get(colour)
    if depth != 8 or interlaced or planes is None:
        raise ValueError("unsupported PNG")
    rows = np.frombuffer(zlib.decompress(body), np.uint8).reshape(height, 1 + width * planes)
    out = np.zeros((height, width * planes), np.uint8)
    above = np.zeros(width * planes, np.int32)
    for y in range(height):
        kind, line = int(rows[y, 0]), rows[y, 1:].astype(np.int32)
        if kind == 0:
            now = line
        elif kind == 2:
            now = (line + above) & 255
        elif kind == 1:
            now = (np.cumsum(line.reshape(-1, planes), 0) & 255).reshape(-1)
        else:
            now = line.copy()
            for i in range(len(now)):
                left, up, corner = (int(now[i - planes]) if i >= planes else 0), int(above[i]), (int(above[i - planes]) if i >= planes else 0)
                if kind == 3:
                    guess = (left + up) // 2
                else:
                    p = left + up - corner
                    guess = min((left, up, corner), key=lambda v: abs(p - v))
                now[i] = (now[i] + guess) & 255
        out[y], above = now, now
    picture = out.reshape(height, width, planes)
    return np.repeat(picture, 3, 2) if planes == 1 else np.ascontiguousarray(picture[:, :, 2::-1])


def encode_png(image: np.ndarray) -> bytes:
    height, width = image.shape[:2]
    rows = np.zeros((height, 1 + width * 3), np.uint8)
    rows[:, 1:] = image[:, :, ::-1].reshape(height, -1)
    chunk = lambda kind, part: struct.pack(">I", len(part)) + kind + part + struct.pack(">I", zlib.crc32(kind + part))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows.tobytes(), 4)) + chunk(b"IEND", b"")


def downscaled(image: np.ndarray, longest: int = LONGEST_SIDE) -> np.ndarray:
    """Averaged down by whole blocks and then sampled, so that no side is longer."""
    side = max(image.shape[:2])
    if side <= longest:
        return image
    k = side // longest
    if k > 1:
        h, w = image.shape[0] // k * k, image.shape[1] // k * k
        image = image[:h, :w].reshape(h // k, k, w // k, k, 3).mean((1, 3)).astype(np.uint8)
    scale = longest / max(image.shape[:2])
    if scale >= 1:
        return image
    ys, xs = (np.minimum((np.arange(round(n * scale)) / scale).astype(int), n - 1) for n in image.shape[:2])
    return image[ys][:, xs]


# ---- building blocks


def grey(image: np.ndarray) -> np.ndarray:
    return np.rint(image @ np.array([0.114, 0.587, 0.299])).astype(np.uint8)


def saturation_hue(image: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Saturation 0 to 255 and hue 0 to 180."""
    x = image.astype(np.float32)
    b, g, r = x[:, :, 0], x[:, :, 1], x[:, :, 2]
    high, low = x.max(2), x.min(2)
    d = np.maximum(high - low, 1e-6)
    hue = np.where(high == r, (g - b) / d % 6, np.where(high == g, (b - r) / d + 2, (r - g) / d + 4)) * 30
    return np.where(high > 0, (high - low) / np.maximum(high, 1e-6) * 255, 0), np.where(high > low, hue, 0)


def box_mean(x: np.ndarray, ry: int, rx: int | None = None) -> np.ndarray:
    """Mean over a window, from an integral image, edges repeated."""
    rx = ry if rx is None else rx
    p = np.pad(x.astype(np.float64), ((ry + 1, ry), (rx + 1, rx)), mode="edge").cumsum(0).cumsum(1)
    h, w = 2 * ry + 1, 2 * rx + 1
    return (p[h:, w:] - p[:-h, w:] - p[h:, :-w] + p[:-h, :-w]) / (h * w)


def blurred(x: np.ndarray, sigma: float) -> np.ndarray:
    """Gaussian blur as three box means."""
    r = max(1, round((np.sqrt(4 * sigma * sigma + 1) - 1) / 2))
    for _ in range(3):
        x = box_mean(x, r)
    return x


def dilated(mask: np.ndarray, ry: int, rx: int | None = None) -> np.ndarray:
    rx = ry if rx is None else rx
    return box_mean(np.pad(mask, 1)[1:-1, 1:-1], ry, rx) > 1e-9


def eroded(mask: np.ndarray, ry: int, rx: int | None = None) -> np.ndarray:
    return ~dilated(~mask, ry, rx)


def otsu(x: np.ndarray) -> int:
    """The threshold that parts the histogram best."""
    n = np.bincount(x.ravel(), minlength=256).astype(float)
    w, s = n.cumsum(), (n * np.arange(256)).cumsum()
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = np.nan_to_num((s[-1] * w - s * w[-1]) ** 2 / (w * (w[-1] - w)))
    return int(gain.argmax())


def components(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Labels (0 outside) of 8-connected parts, and rows x0, y0, x1, y1, area by label - 1; runs are joined row by row."""
    height, width = mask.shape
    padded = np.zeros((height, width + 2), np.int8)
    padded[:, 1:-1] = mask
    step = np.diff(padded, axis=1)
    ys, starts = np.nonzero(step == 1)
    ends = np.nonzero(step == -1)[1]
    parent = np.arange(len(ys))

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    first = np.searchsorted(ys, np.arange(height + 1))
    for y in range(1, height):
        i, j = first[y - 1], first[y]
        while i < first[y] and j < first[y + 1]:
            if starts[i] <= ends[j] and starts[j] <= ends[i]:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
            if ends[i] < ends[j]:
                i += 1
            else:
                j += 1
    roots = np.array([find(i) for i in range(len(ys))], int)
    labels, own = np.zeros((height, width), np.int32), np.unique(roots, return_inverse=True)[1] + 1 if len(ys) else np.zeros(0, int)
    for y, a, b, k in zip(ys, starts, ends, own, strict=True):
        labels[y, a:b] = k
    k = int(own.max(initial=0))
    stats = np.zeros((k, 5), int)
    if k:
        stats[:, 0], stats[:, 1] = width, height
        np.minimum.at(stats[:, 0], own - 1, starts)
        np.minimum.at(stats[:, 1], own - 1, ys)
        np.maximum.at(stats[:, 2], own - 1, ends)
        np.maximum.at(stats[:, 3], own - 1, ys + 1)
        np.add.at(stats[:, 4], own - 1, ends - starts)
    return labels, stats


def warped(image: np.ndarray, xs: np.ndarray, ys: np.ndarray) -> np.ndarray:
    """The picture sampled between pixels at given places, edges repeated."""
    h, w = image.shape[:2]
    xs, ys = np.clip(xs, 0, w - 1), np.clip(ys, 0, h - 1)
    x0, y0 = np.minimum(xs.astype(int), w - 2) if w > 1 else xs.astype(int), np.minimum(ys.astype(int), h - 2) if h > 1 else ys.astype(int)
    x1, y1, fx, fy = np.minimum(x0 + 1, w - 1), np.minimum(y0 + 1, h - 1), (xs - x0)[..., None], (ys - y0)[..., None]
    f = image.astype(np.float32)
    top, low = f[y0, x0] * (1 - fx) + f[y0, x1] * fx, f[y1, x0] * (1 - fx) + f[y1, x1] * fx
    return np.rint(top * (1 - fy) + low * fy).astype(np.uint8)


# ---- page kernels: each returns the new picture and its metrics


def _line_score(mask: np.ndarray) -> float:
    """How much of a mask is joined to lines along the x axis."""
    joined = eroded(dilated(mask, 1, 12), 1, 12)
    _, stats = components(joined)
    if not len(stats):
        return 0.0
    w, h = stats[:, 2] - stats[:, 0], stats[:, 3] - stats[:, 1]
    ok = (h >= 2) & (w / np.maximum(h, 1) >= 2.8) & (w * h <= mask.size * 0.08)
    return float((np.minimum(w, 180) * np.minimum(w / np.maximum(h, 1), 8))[ok].sum())


def text_direction(image: np.ndarray) -> float:
    """Above 0 where ink joins to lines along the rows rather than along the columns."""
    g = grey(downscaled(image, 600)).astype(float)
    ink = g < box_mean(g, 15) - 15
    return float(np.log1p(_line_score(ink)) - np.log1p(_line_score(ink.T)))


def orient(image: np.ndarray, turn: int | None = None) -> tuple[np.ndarray, dict]:
    """Upright by the direction of text lines, or as the boxes of recognised lines told (90, -90, 180 degrees clockwise)."""
    if turn in (90, -90, 180):
        return np.ascontiguousarray(np.rot90(image, {90: -1, -90: 1, 180: 2}[turn])), {"rotation_degrees": turn, "orientation_confidence": 0.9, "orientation_scores": [], "orientation_source": "ocr-boxes"}
    turned = np.ascontiguousarray(np.rot90(image, -1))
    flat, upright = text_direction(image), text_direction(turned)
    sure = {"orientation_confidence": round(min(1.0, 0.5 + abs(upright - flat) / 4), 4), "orientation_scores": [round(flat, 4), round(upright, 4)], "orientation_source": "image-heuristic"}
    return (turned, {"rotation_degrees": 90, **sure}) if upright > flat else (image, {"rotation_degrees": 0, **sure})


def rectify(image: np.ndarray) -> tuple[np.ndarray, dict]:
    """The brightest large quadrilateral as the whole picture; a page that fills it stays."""
    g = grey(image)
    labels, stats = components(g > otsu(g))
    none = {"page_confidence": 0.0, "page_rectified": False}
    if not len(stats):
        return image, none
    k = int(stats[:, 4].argmax())
    share = stats[k, 4] / g.size
    if share < 0.25:
        return image, none
    ys, xs = np.nonzero(labels == k + 1)
    corner = lambda v: (int(xs[v.argmax()]), int(ys[v.argmax()]))
    quad = np.array([corner(-(xs + ys)), corner(xs - ys), corner(xs + ys), corner(ys - xs)], float)
    shifted = np.roll(quad, -1, 0)
    area = abs((quad[:, 0] * shifted[:, 1] - shifted[:, 0] * quad[:, 1]).sum()) / 2
    fit = min(1.0, stats[k, 4] / max(area, 1.0)) if area >= 0.25 * g.size else 0.0
    sure = round(float(fit * min(1.0, share / 0.5)), 4)
    if sure < 0.30 or area > 0.97 * g.size:
        return image, {"page_confidence": sure, "page_rectified": False}
    w = round(max(np.hypot(*(quad[1] - quad[0])), np.hypot(*(quad[2] - quad[3]))))
    h = round(max(np.hypot(*(quad[3] - quad[0])), np.hypot(*(quad[2] - quad[1]))))
    to = np.array([(0, 0), (w - 1, 0), (w - 1, h - 1), (0, h - 1)], float)
    rows, want = [], []
    for (u, v), (x, y) in zip(to, quad, strict=True):
        rows += [[u, v, 1, 0, 0, 0, -u * x, -v * x], [0, 0, 0, u, v, 1, -u * y, -v * y]]
        want += [x, y]
    m = np.append(np.linalg.solve(np.array(rows), np.array(want)), 1).reshape(3, 3)
    u, v = np.meshgrid(np.arange(w), np.arange(h))
    d = m[2, 0] * u + m[2, 1] * v + m[2, 2]
    return warped(image, (m[0, 0] * u + m[0, 1] * v + m[0, 2]) / d, (m[1, 0] * u + m[1, 1] * v + m[1, 2]) / d), {"page_confidence": sure, "page_rectified": True}


def deskew(image: np.ndarray) -> tuple[np.ndarray, dict]:
    """Turned by the angle within 15 degrees at which the rows' ink is most uneven; under 0.15 degrees it stays."""
    g = grey(downscaled(image, 800))
    ys, xs = np.nonzero(g < min(180, int(np.percentile(g, 35)) + 1))
    if len(ys) < 50:
        return image, {"deskew_angle": 0.0}

    def unevenness(a: float) -> float:
        n = np.bincount(np.rint(ys - np.tan(np.radians(a)) * xs - min(0, -np.tan(np.radians(a)) * g.shape[1])).astype(int))
        return float((n.astype(float) ** 2).sum())

    angle = max(np.arange(-15, 15.01, 0.5), key=unevenness)
    angle = float(max(np.arange(angle - 0.5, angle + 0.51, 0.05), key=unevenness))
    if abs(angle) < 0.15:
        return image, {"deskew_angle": round(angle, 4)}
    h, w = image.shape[:2]
    x, y = np.meshgrid(np.arange(w) - w / 2, np.arange(h) - h / 2)
    c, s = np.cos(np.radians(angle)), np.sin(np.radians(angle))
    return warped(image, c * x - s * y + w / 2, s * x + c * y + h / 2), {"deskew_angle": round(angle, 4)}


def dewarp(image: np.ndarray, bins: int = 36) -> tuple[np.ndarray, dict]:
    """Straightened along the strongest text line's curve, if it is one: bent enough, not too much, and close to the ink."""
    g = grey(image)
    h, w = g.shape
    ink = g < min(180, int(np.percentile(g, 35)))
    ink = dilated(eroded(ink, 0, 0), 0, 0)
    flat = {"dewarp_applied": False, "baseline_amplitude": 0.0, "baseline_residual": 0.0}
    density = ink.sum(1)
    if density.max(initial=0) < w * 0.08:
        return image, flat
    middle, r = int(density.argmax()), max(20, h // 80)
    y0, y1 = max(0, middle - r), min(h, middle + r + 1)
    xs, ys = [], []
    for i in range(bins):
        a, b = round(i * w / bins), round((i + 1) * w / bins)
        rows = np.nonzero(ink[y0:y1, a:b])[0]
        if len(rows) >= 5:
            xs.append((a + b) / 2)
            ys.append(float(np.median(rows)) + y0)
    if len(xs) < bins * 0.55:
        return image, flat
    fit = np.polyfit(xs, ys, 2)
    curve = np.polyval(fit, np.arange(w))
    bend = curve - np.linspace(curve[0], curve[-1], w)
    amplitude, residual = float(np.ptp(bend)), float(np.sqrt(np.mean((np.array(ys) - np.polyval(fit, xs)) ** 2)))
    ok = max(4.0, h * 0.003) <= amplitude <= h * 0.04 and residual <= 8
    measured = {"dewarp_applied": ok, "baseline_amplitude": round(amplitude, 3), "baseline_residual": round(residual, 3)}
    if not ok:
        return image, measured
    x, y = np.meshgrid(np.arange(w, dtype=float), np.arange(h, dtype=float))
    return warped(image, x, y + bend[None, :]), measured


def normalize_background(image: np.ndarray) -> tuple[np.ndarray, dict]:
    """Even light: the blurred brightness goes, its upper quartile stays."""
    g = grey(image).astype(float)
    around = blurred(g, max(15.0, image.shape[1] / 45))
    return np.clip(np.rint(image + (np.percentile(around, 75) - around)[:, :, None]), 0, 255).astype(np.uint8), {}


def crop_to_content(image: np.ndarray) -> tuple[np.ndarray, dict]:
    """The box around what looks like print, padded."""
    g = grey(image).astype(float)
    h, w = g.shape
    ink = (g < 205) & (np.abs(g - blurred(g, 21)) > 7)
    _, s = components(eroded(dilated(ink, 1, 2), 1, 2))
    whole = {"content_crop_applied": False}
    if len(s):
        s = s[(s[:, 4] >= 5) & (s[:, 4] <= h * w * 0.08) & (s[:, 2] - s[:, 0] < w * 0.95) & (s[:, 3] - s[:, 1] < h * 0.95)]
    if not len(s):
        return image, whole
    x0, y0, x1, y1 = s[:, 0].min(), s[:, 1].min(), s[:, 2].max(), s[:, 3].max()
    px, py = max(24, round((x1 - x0) * 0.04)), max(24, round((y1 - y0) * 0.08))
    x0, y0, x1, y1 = int(max(0, x0 - px)), int(max(0, y0 - py)), int(min(w, x1 + px)), int(min(h, y1 + py))
    return (image, whole) if (x1 - x0) * (y1 - y0) < h * w * 0.08 else (image[y0:y1, x0:x1], {"content_crop_applied": True})


def remove_marks(image: np.ndarray) -> tuple[np.ndarray, dict]:
    """Red and pencil marks replaced by the background, never within reach of print."""
    g = grey(image).astype(float)
    sat, hue = saturation_hue(image)
    red_raw = (sat > 65) & ((hue < 15) | (hue > 168)) & (image[:, :, 2].astype(int) - image[:, :, 1] > 12)
    labels, s = components(red_raw)
    red = np.zeros_like(red_raw)
    if len(s):
        box = np.maximum(1, (s[:, 2] - s[:, 0]) * (s[:, 3] - s[:, 1]))
        keep = (s[:, 4] >= 3) & (s[:, 4] <= max(10000, g.size * 0.008)) & ((box <= g.size * 0.04) | (s[:, 4] / box < 0.35))
        red = np.r_[False, keep][labels]
    pale = sat < 38
    protected = dilated(((g < 125) & pale) | ((g < 92) & ~red), 4)
    around = blurred(g, 13)
    pencil = pale & (g >= 138) & (g < 205) & (around > 188) & (around - g > 11) & (box_mean(g > 188, 8) > 0.72)
    safe = ((red & (g > 70)) | pencil) & ~protected
    safe = dilated(eroded(safe, 0, 0), 0, 0) & ~protected
    paper = np.stack([blurred(image[:, :, c].astype(float), 18) for c in range(3)], 2)
    out = np.where(safe[:, :, None], np.rint(paper), image).astype(np.uint8)
    changed = (out != image).any(2)
    return out, {"red_candidate_pixels": int(red.sum()), "pencil_candidate_pixels": int(pencil.sum()), "removed_pixels": int(changed.sum()), "protected_overlap_pixels": int((changed & protected).sum()), "removed_fraction": round(float(changed.mean()), 6)}


def blur_score(image: np.ndarray) -> float:
    """Variance of the Laplacian; low for unsharp pictures."""
    g = np.pad(grey(image).astype(float), 1, mode="reflect")
    return float((g[:-2, 1:-1] + g[2:, 1:-1] + g[1:-1, :-2] + g[1:-1, 2:] - 4 * g[1:-1, 1:-1]).var())


def red_fraction(image: np.ndarray) -> float:
    sat, hue = saturation_hue(image)
    return float(((sat > 65) & ((hue < 15) | (hue > 168))).mean())


def formula_variants(crop: np.ndarray) -> dict[str, np.ndarray]:
    """A formula's crop as it is, in black and white, and so after stretching its contrast."""
    g = grey(crop)
    low, high = np.percentile(g, (2, 98))
    stretched = np.clip((g - low) * 255.0 / max(high - low, 1), 0, 255).astype(np.uint8)
    binary = lambda x: np.repeat(np.where(x > otsu(x), 255, 0).astype(np.uint8)[:, :, None], 3, 2)
    return {"original": crop, "binary": binary(g), "contrast": binary(stretched)}


def tiles(height: int, width: int, size: int = 1024, overlap: int = 192) -> list[tuple[int, int, int, int]]:
    """Overlapping windows x0, y0, x1, y1 that cover a picture."""
    step = size - overlap
    starts = lambda n: sorted({*range(0, max(1, n - size + 1), step), max(0, n - size)})
    return [(x, y, min(width, x + size), min(height, y + size)) for y in starts(height) for x in starts(width)]


def blend(parts: list[tuple[tuple[int, int, int, int], np.ndarray]], height: int, width: int) -> np.ndarray:
    """Tiles' masks as one, weighted towards their centres."""
    total, weight = np.zeros((height, width)), np.full((height, width), 1e-300)
    for (x0, y0, x1, y1), mask in parts:
        k = np.outer(np.hanning(y1 - y0 + 2)[1:-1], np.hanning(x1 - x0 + 2)[1:-1])
        total[y0:y1, x0:x1] += mask * k
        weight[y0:y1, x0:x1] += k
    return total / weight


METRICS = "rotation_degrees int, orientation_confidence double, page_confidence double, page_rectified boolean, deskew_angle double, dewarp_applied boolean, baseline_amplitude double, baseline_residual double, content_crop_applied boolean, red_candidate_pixels long, pencil_candidate_pixels long, removed_pixels long, protected_overlap_pixels long, removed_fraction double, blur double, width int, height int"


def process(image: np.ndarray, turn: int | None = None) -> tuple[np.ndarray, dict]:
    """All page steps in order."""
    metrics: dict = {}
    for step in (lambda x: orient(x, turn), rectify, deskew, dewarp, normalize_background, crop_to_content, remove_marks):
        image, m = step(image)
        metrics |= m
    return image, metrics | {"blur": blur_score(image), "width": image.shape[1], "height": image.shape[0]}


def map_images(df: DataFrame, key: str, content: str, kernel: Callable[[np.ndarray], dict], schema: str, decoder: Callable[[bytes], np.ndarray] = decode_png, longest: int = LONGEST_SIDE) -> DataFrame:
    """`key`, the kernel's fields and `error` for every picture; one that can't be read gives an error and nulls."""
    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for k, data in zip(batch[key], batch[content], strict=True):
                try:
                    out.append({key: k, **dict.fromkeys(names), **kernel(downscaled(decoder(bytes(data)), longest)), "error": None})
                except Exception as e:  # noqa: BLE001 - a bad file must not fail the others
                    out.append({key: k, **dict.fromkeys(names), "error": f"{type(e).__name__}: {e}"})
            yield pd.DataFrame(out, columns=[key, *names, "error"])

    return df.select(key, content).mapInPandas(run, f"{key} {df.schema[key].dataType.simpleString()}, {schema}, error string")


def process_images(df: DataFrame, key: str, content: str, decoder: Callable[[bytes], np.ndarray] = decode_png) -> DataFrame:
    """`key`, the cleaned picture as PNG and all metrics."""

    def kernel(image: np.ndarray) -> dict:
        out, metrics = process(image)
        return {"png": encode_png(out), **metrics}

    return map_images(df, key, content, kernel, f"png binary, {METRICS}", decoder)


def gate_reasons() -> Column:
    """Why a processed page needs review, from its metrics."""
    tests = [F.when(F.col(c) < v if op == "<" else F.col(c) > v, reason) for c, op, v, reason in GATES]
    return F.array_compact(F.array(*tests))


def mask_fractions(mask: Column) -> Column:
    """Shares of an array's values at 0.3, 0.5 and 0.7 or more."""
    share = lambda t: F.size(F.filter(mask, lambda v: v >= t)) / F.size(mask)
    return F.struct(*[share(t).alias(f"share_{int(t * 100)}") for t in (0.3, 0.5, 0.7)])


def erased(image: np.ndarray, mask: np.ndarray, threshold: float = 0.5, reach: int = 2) -> np.ndarray:
    """White where a mask, and a little around it, is over the threshold."""
    return np.where(dilated(mask >= threshold, reach)[:, :, None], 255, image).astype(np.uint8)


def print_layer(image: np.ndarray, window: int = 31, offset: float = 15) -> np.ndarray:
    """Black where a pixel is darker than its surroundings by the offset, white elsewhere."""
    g = grey(image).astype(float)
    return np.repeat(np.where(g < box_mean(g, window // 2) - offset, 0, 255).astype(np.uint8)[:, :, None], 3, 2)


def question_picture(image: np.ndarray, text_box: tuple[int, int, int, int], figure_box: tuple[int, int, int, int] | None, margin: int = 24) -> np.ndarray:
    """The question's text, and its figure below it, on white."""
    parts = [image[b[1] : b[3], b[0] : b[2]] for b in (text_box, figure_box) if b is not None]
    width = max(p.shape[1] for p in parts) + 2 * margin
    out = np.full((sum(p.shape[0] for p in parts) + margin * (len(parts) + 1), width, 3), 255, np.uint8)
    y = margin
    for p in parts:
        out[y : y + p.shape[0], margin : margin + p.shape[1]] = p
        y += p.shape[0] + margin
    return out
