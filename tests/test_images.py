"""Image and figure kernels on drawn pictures, and their gates as columns."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioflow.operators import figures as Fig
from folioflow.operators import image as Im


def page(height=320, width=640):
    """Grey paper with lines of dark bars for words."""
    x = np.full((height, width, 3), 245, np.uint8)
    for y in range(60, height - 60, 40):
        for a in range(60, width - 100, 50):
            x[y : y + 10, a : a + 38] = 20
    return x


def test_png_round_trip():
    x = np.random.default_rng(1).integers(0, 256, (17, 23, 3), np.uint8)
    assert (Im.decode_png(Im.encode_png(x)) == x).all()
    with pytest.raises(ValueError):
        Im.decode_png(b"no")


def test_components_match_a_flood_fill():
    mask = np.random.default_rng(2).random((30, 40)) < 0.45
    labels, stats = Im.components(mask)
    seen, n = np.zeros_like(mask), 0
    for y, x in zip(*np.nonzero(mask), strict=True):
        if seen[y, x]:
            continue
        n += 1
        todo, part = [(y, x)], []
        seen[y, x] = True
        while todo:
            a, b = todo.pop()
            part.append((a, b))
            for c in range(max(0, a - 1), min(30, a + 2)):
                for d in range(max(0, b - 1), min(40, b + 2)):
                    if mask[c, d] and not seen[c, d]:
                        seen[c, d] = True
                        todo.append((c, d))
        k = labels[y, x]
        assert k and all(labels[p] == k for p in part) and stats[k - 1, 4] == len(part)
    assert n == len(stats) and (labels > 0).sum() == mask.sum()
    assert len(Im.components(np.zeros((3, 3), bool))[1]) == 0


def test_marks_go_and_print_stays():
    x = page()
    x[30:34, 100:500] = (40, 40, 220)
    out, m = Im.remove_marks(x)
    assert m["removed_pixels"] > 0 and m["protected_overlap_pixels"] == 0
    assert (out[60:70, 60:98] == x[60:70, 60:98]).all()
    assert Im.red_fraction(x) > Im.red_fraction(out)


def test_turned_pages_are_found():
    _, m = Im.orient(page(400, 700))
    assert m["rotation_degrees"] == 0
    out, m = Im.orient(np.ascontiguousarray(np.rot90(page(400, 700))))
    assert m["rotation_degrees"] == 90 and out.shape == (400, 700, 3)
    assert Im.orient(page(), 180)[1]["orientation_confidence"] == 0.9


def test_page_steps():
    x = page(400, 700)
    assert abs(Im.deskew(x)[1]["deskew_angle"]) < 0.3
    h, w = x.shape[:2]
    a = np.radians(3)
    u, v = np.meshgrid(np.arange(w) - w / 2, np.arange(h) - h / 2)
    turned = Im.warped(x, np.cos(a) * u + np.sin(a) * v + w / 2, -np.sin(a) * u + np.cos(a) * v + h / 2)
    assert abs(abs(Im.deskew(turned)[1]["deskew_angle"]) - 3) < 0.4
    assert Im.deskew(Im.deskew(turned)[0])[1]["deskew_angle"] == pytest.approx(0, abs=0.4)
    dark = (x * np.linspace(0.5, 1, w)[None, :, None]).astype(np.uint8)
    assert np.ptp(Im.grey(Im.normalize_background(dark)[0])[10:30].mean(0)[60:-60]) < np.ptp(Im.grey(dark)[10:30].mean(0)[60:-60])
    assert Im.crop_to_content(x)[1]["content_crop_applied"] in (True, False)
    assert Im.dewarp(np.full((50, 50, 3), 255, np.uint8))[1]["dewarp_applied"] is False
    table = np.full((300, 400, 3), 30, np.uint8)
    table[40:260, 50:340] = 240
    out, m = Im.rectify(table)
    assert m["page_rectified"] and abs(out.shape[0] - 220) < 6 and abs(out.shape[1] - 290) < 6
    assert Im.blur_score(x) > Im.blur_score(np.repeat(Im.blurred(Im.grey(x).astype(float), 4).astype(np.uint8)[:, :, None], 3, 2))
    assert set(Im.formula_variants(x[50:80, 50:200])) == {"original", "binary", "contrast"}
    assert Im.downscaled(np.zeros((5300, 100, 3), np.uint8)).shape[0] <= 2600


def test_tiles_cover_and_blend():
    t = Im.tiles(1500, 900)
    cover = np.zeros((1500, 900), bool)
    for x0, y0, x1, y1 in t:
        cover[y0:y1, x0:x1] = True
    assert cover.all() and len(t) == 2
    assert np.allclose(Im.blend([(b, np.ones((b[3] - b[1], b[2] - b[0]))) for b in t], 1500, 900), 1)


def drawn(shape, segments):
    x = np.full((*shape, 3), 255, np.uint8)
    x[Fig.line_mask(shape, segments, 4)] = 0
    return x


MAP = [(40, 40, 460, 40), (40, 390, 460, 390), (40, 40, 40, 390), (460, 40, 460, 390), (40, 215, 460, 215), (180, 40, 180, 215), (320, 40, 320, 215), (250, 215, 250, 390)]


def test_map_regions_neighbours_and_colourings():
    places = {"A": (110, 120), "B": (250, 120), "C": (390, 120), "E": (360, 300)}
    m = Fig.map_figure(drawn((430, 500), MAP), list("ABCDE"), places)
    assert (m["n_regions"], m["n_named"], m["n_inferred"]) == (5, 5, 1) and m["line_support"] >= 0.82
    edges = [tuple(e) for e in m["edges"]]
    assert edges == [("A", "B"), ("A", "D"), ("B", "C"), ("B", "D"), ("B", "E"), ("C", "E"), ("D", "E")]
    assert Fig.colourings(list("ABCDE"), edges, 4) == 96


def test_grid_and_circles():
    grid = [(50, y, 550, y) for y in (60, 110, 160)] + [(x, 60, x, 160) for x in range(50, 551, 50)]
    g = Fig.grid_figure(drawn((220, 600), grid))
    assert (g["n_horizontal"], g["n_vertical"]) == (3, 11) and g["line_support"] >= 0.82
    circles = [(150, 110, 60), (115, 170, 60), (185, 170, 60)]
    x = np.full((290, 300, 3), 255, np.uint8)
    x[Fig.circle_mask((290, 300), circles)] = 0
    c = Fig.circles_figure(x, range(54, 67, 3))
    assert c["n_circles"] == 3 and c["n_regions"] == 7 and c["line_support"] >= 0.62
    assert Fig.circles_figure(np.full((60, 60, 3), 255, np.uint8))["n_circles"] == 0
    assert Fig.reconstruct(x, "none") == {"kind": "none"}


def test_fidelity_and_location():
    a = drawn((300, 400), [(50, 50, 350, 50), (50, 50, 50, 250)])
    b = drawn((300, 400), [(50, 250, 350, 250), (350, 50, 350, 250)])
    assert Fig.fidelity(a, a)["same"] and not Fig.fidelity(a, b)["same"]
    assert Fig.locate_figure(a) is not None and Fig.locate_figure(np.full((30, 30, 3), 255, np.uint8)) is None


def test_images_through_spark(spark):
    df = spark.createDataFrame([(1, bytearray(Im.encode_png(page()))), (2, bytearray(b"bad"))], "id int, content binary")
    out = {r["id"]: r for r in Im.process_images(df, "id", "content").withColumn("reasons", Im.gate_reasons()).collect()}
    assert out[1]["error"] is None and Im.decode_png(bytes(out[1]["png"])).shape[0] > 0 and out[1]["width"] > 0
    assert out[2]["error"].startswith("ValueError") and out[2]["png"] is None
    measured = spark.createDataFrame([("grid_2x10", 3, 11, None, None, None, None, None, 0.9, None), ("grid_2x10", 3, 11, None, None, None, None, None, 0.8, None), ("three_overlapping_circles", None, None, 7, None, None, None, 3, 0.7, None), ("five_country_map", 5, 3, 5, 5, 5, 1, None, 0.9, [["A", "B"]] * 5), ("x", *[None] * 9)], Fig.MEASURES)
    assert [r[0] for r in measured.select(Fig.passed()).collect()] == [True, False, True, True, False]
    share = spark.range(1).select(Im.mask_fractions(F.array(*map(F.lit, (0.2, 0.4, 0.6, 0.8)))).alias("x")).first()["x"]
    assert tuple(share) == (0.75, 0.5, 0.25)


def test_figures_through_spark(spark):
    grid = [(50, y, 550, y) for y in (60, 110, 160)] + [(x, 60, x, 160) for x in range(50, 551, 50)]
    rows = [(1, bytearray(Im.encode_png(drawn((430, 500), MAP))), "five_country_map", list("ABCDE"), {"A": [110, 120], "B": [250, 120], "C": [390, 120], "E": [360, 300]}), (2, bytearray(Im.encode_png(drawn((220, 600), grid))), "grid_2x10", None, None), (3, bytearray(b"x"), "grid_2x10", None, None)]
    df = spark.createDataFrame(rows, "id int, content binary, kind string, expected array<string>, places map<string,array<int>>")
    out = {r["id"]: r for r in Fig.reconstruct_images(df, "id", "content").withColumn("ok", Fig.passed()).collect()}
    # the drawn map has three horizontal lines, the gate asks for five
    assert [out[i]["ok"] for i in (1, 2, 3)] == [False, True, False] and out[1]["n_horizontal"] == 3 and out[3]["error"] and len(out[1]["edges"]) == 7
