"""Content blocks: questions as arrays of text, formula and image parts."""

from __future__ import annotations

import unicodedata

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioflow.functions import text as T

BLOCK = "struct<type:string,text:string,latex:string,display:boolean,source_text:string,asset:string,alt:string,source_box:array<int>,row_index:int,formula_id:string,recognition_state:string,clean_crop_asset:string>"
# Operands and operators of arithmetic within prose; letters that recognition takes for digits.
OPERAND = r"(?:[0-9]+(?:\.[0-9]+)?|[A-Za-z])"
OPERATOR = r"(?:[+\-=:/]|[xX*]|×|÷|≤|≥)"
FORMULA = rf"(?<![0-9A-Za-z]){OPERAND}(?:\s*{OPERATOR}\s*{OPERAND})+"
UNSUPPORTED = r"[√∑∫≈≠{}]|[A-Za-z0-9][\^_][A-Za-z0-9]|[(（][^)）]*[+\-×÷=:/≤≥][^)）]*[)）]|\\(?:frac|sqrt|sum|int)"
CONFUSIONS = {"0": "o", "1": "il", "5": "s", "6": "b", "8": "&b", "9": "g"}
QUESTION_TITLE = r"(?iu)[【\[(（]?(?:例题|练习|第)\s*[0-9S]+\s*(?:题)?[】\])）]?"
IMAGE_MARK = "［公式图像］"


def block(kind: str, **parts: Column) -> Column:
    """A block with the given parts; the rest are null."""
    types = dict(f.split(":", 1) for f in BLOCK[7:-1].split(","))
    return F.struct(*[(F.lit(kind) if n == "type" else parts.get(n, F.lit(None)).cast(t)).alias(n) for n, t in types.items()])


def latex_for(expression: Column) -> Column:
    """An arithmetic span as LaTeX. Any x stands for a times sign, variables named x too."""
    t = T.compact(expression)
    for signs, name in (("×xX*", "times"), ("÷", "div"), ("≤", "le"), ("≥", "ge")):
        t = F.regexp_replace(t, f"[{signs}]", rf" \\{name} ")
    return F.trim(t)


def split_text_and_latex(text: Column) -> Column:
    """Text and inline formulas in turn, as array<block>; empty parts are left out."""
    t = T.text_of(text)
    prose = F.transform(F.split(t, FORMULA, -1), lambda p: block("text", text=p))
    maths = F.transform(F.regexp_extract_all(t, F.lit(FORMULA), 0), lambda m: block("latex", latex=latex_for(m), display=F.lit(False), source_text=m))
    turns = F.flatten(F.transform(F.arrays_zip(prose.alias("p"), maths.alias("m")), lambda z: F.array(z["p"], z["m"])))
    return F.filter(turns, lambda b: b.isNotNull() & ((F.coalesce(b["text"], F.lit("")) != "") | (F.coalesce(b["latex"], F.lit("")) != "")))


def build(text: Column, figure: Column | None = None, figure_box: Column | None = None) -> Column:
    """A question's blocks, its figure last."""
    blocks = split_text_and_latex(F.trim(T.text_of(text)))
    if figure is None:
        return blocks
    image = block("image", asset=figure, alt=F.lit("question figure"), source_box=figure_box if figure_box is not None else F.array().cast("array<int>"))
    return F.when(T.text_of(figure) != "", F.concat(blocks, F.array(image))).otherwise(blocks)


def with_fallbacks(text: Column, lines: Column) -> Column:
    """Blocks in which recognised lines with mathematics that text can't show are images.

    `lines` is array<struct<text, box:array<int>>> with pixel boxes. Lines are
    taken by where they stand in the text; one that begins in an earlier one is left out.
    """
    t = T.text_of(text)
    hard = F.filter(lines, lambda x: (F.trim(x["text"]) != "") & x["text"].rlike(UNSUPPORTED) & (F.instr(t, F.trim(x["text"])) > 0) & (F.size(x["box"]) == 4))
    events = F.array_sort(F.transform(hard, lambda x, i: F.struct((F.instr(t, F.trim(x["text"])) - 1).alias("a"), F.length(F.trim(x["text"])).alias("n"), i.alias("i"), F.trim(x["text"]).alias("t"), x["box"].alias("b"))))
    empty = F.struct(F.array().cast(f"array<{BLOCK}>").alias("out"), F.lit(0).alias("at"))

    def step(s: Column, e: Column) -> Column:
        image = block("image", asset=F.concat(F.lit("formula-fallback-"), F.format_string("%02d", e["i"] + 1), F.lit(".png")), alt=F.lit("formula"), source_box=e["b"], source_text=e["t"])
        before = split_text_and_latex(F.substr(t, s["at"] + 1, e["a"] - s["at"]))
        return F.when(e["a"] < s["at"], s).otherwise(F.struct(F.concat(s["out"], before, F.array(image)).alias("out"), (e["a"] + e["n"]).alias("at")))

    return F.aggregate(events, empty, step, lambda s: F.concat(s["out"], split_text_and_latex(F.substr(t, s["at"] + 1))))


def question_only(blocks: Column, title: Column) -> Column:
    """The blocks from behind the title to the terminal, figures last; without a title all text and formulas stay."""
    state = F.struct(F.array().cast(f"array<{BLOCK}>").alias("out"), F.lit(False).alias("on"), F.lit(False).alias("done"), F.lit("").alias("seen"))
    parts = F.filter(blocks, lambda b: b["type"] != "image")
    literal = lambda b: F.when(F.length(title) > 0, F.instr(T.text_of(b["text"]), title)).otherwise(1)

    def step(s: Column, b: Column) -> Column:
        at = literal(b)
        shaped = T.match_end(b["text"], QUESTION_TITLE)
        begins = (b["type"] == "text") & ~s["on"] & ((at > 0) | (shaped >= 0))
        rest = F.when(~s["on"] & (at > 0), F.substr(b["text"], at + F.length(title))).when(~s["on"], F.substr(b["text"], shaped + 1)).otherwise(b["text"])
        on = s["on"] | begins
        text_part = on & (b["type"] == "text") & (rest != "")
        maths = s["on"] & (b["type"] == "latex")
        seen = F.concat(s["seen"], F.when(text_part, rest).when(maths, F.lit(" FORMULA ")).otherwise(F.lit("")))
        own = F.when(text_part, F.array(b.withField("text", rest))).when(maths, F.array(b)).otherwise(F.array().cast(f"array<{BLOCK}>"))
        return F.when(s["done"], s).otherwise(F.struct(F.concat(s["out"], own).alias("out"), on.alias("on"), (on & T.has_terminal(seen)).alias("done"), seen.alias("seen")))

    kept = F.aggregate(parts, state, step, lambda s: F.when(s["on"], s["out"]).otherwise(parts))
    return F.concat(kept, F.filter(blocks, lambda b: b["type"] == "image"))


def to_text(blocks: Column, title: Column) -> Column:
    """The title and the blocks as text: rows on lines, formulas in their delimiters, up to the terminal."""
    start = F.struct(F.lit("").alias("out"), F.lit(None).cast("int").alias("row"))

    def step(s: Column, b: Column) -> Column:
        turn = F.when(b["row_index"].isNotNull() & s["row"].isNotNull() & (b["row_index"] != s["row"]), "\n").otherwise("")
        latex = F.trim(T.text_of(b["latex"]))
        maths = F.when(b["recognition_state"].eqNullSafe("human_verified_image"), IMAGE_MARK).when(latex == "", "").when(F.coalesce(b["display"], F.lit(False)), F.concat(F.lit("\\["), latex, F.lit("\\]"))).otherwise(F.concat(F.lit("\\("), latex, F.lit("\\)")))
        own = F.when(b["type"] == "text", T.text_of(b["text"])).when(b["type"] == "latex", maths).otherwise("")
        return F.struct(F.concat(s["out"], turn, own).alias("out"), F.coalesce(b["row_index"], s["row"]).alias("row"))

    parts = F.filter(blocks, lambda b: b["type"] != "image")
    body = F.trim(F.aggregate(parts, start, step, lambda s: s["out"]))
    body = F.trim(T.cut_at_terminal(F.regexp_replace(body, r"(\\\))[\s.。．oO]+(?=[,，])", "$1")))
    return F.trim(F.concat_ws(" ", title, body))


def rows(df: DataFrame, by: list[str], order: list[str], kind: str = "type", row: str | None = None) -> DataFrame:
    """Islands of flat block rows: `df` with `row_no`.

    Images and displayed formulas stand alone, and a change of a given row
    index begins a new row. Needs columns `kind` and, if given, `display` and `row`.
    """
    w = Window.partitionBy(*by).orderBy(*order)
    alone = (F.col(kind) == "image") | ((F.col(kind) == "latex") & (F.coalesce(F.col("display"), F.lit(False)) if "display" in df.columns else F.lit(False)))
    after = F.lag(alone).over(w)
    turn = F.lit(False)
    if row:
        # the last index given before, within any run of rows that a lone block has not ended
        last = F.last(F.col(row), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
        turn = F.col(row).isNotNull() & last.isNotNull() & (F.col(row) != last)
    starts = F.coalesce(alone | after | turn, F.lit(True))
    return df.withColumn("row_no", F.sum(starts.cast("int")).over(w))


def change_islands(df: DataFrame, by: list[str], order: list[str], value: str) -> DataFrame:
    """`df` with `island`: a new number where `value` changes along the order."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("island", F.sum((~F.col(value).eqNullSafe(F.lag(value).over(w))).cast("int")).over(w))


def restore_radix_variable(blocks: Column, source: Column) -> Column:
    """The letter between 在 and 进制 put back where the blocks have lost it, once."""
    variable = F.regexp_extract(T.text_of(source), r"在\s*([A-Za-z])\s*进制", 1)
    there = F.exists(blocks, lambda b: (b["type"] == "text") & T.text_of(b["text"]).contains(F.concat(F.lit("在"), variable, F.lit("进制"))))
    nxt = lambda i: F.get(blocks, i + 1)
    gap = lambda b, i: (b["type"] == "text") & F.rtrim(T.text_of(b["text"])).endswith("在") & (nxt(i)["type"] == "text") & F.ltrim(T.text_of(nxt(i)["text"])).startswith("进制")
    first = F.array_position(F.transform(blocks, lambda b, i: F.coalesce(gap(b, i), F.lit(False))), True)
    fixed = F.transform(blocks, lambda b, i: F.when(i + 1 == first, b.withField("text", F.concat(b["text"], variable))).otherwise(b))
    return F.when((variable == "") | there, blocks).otherwise(fixed)


def block_asset(b: Column) -> Column:
    """The picture that stands for a block, or an empty string."""
    return F.when(b["type"] == "image", T.text_of(b["asset"])).when((b["type"] == "latex") & b["recognition_state"].isin("needs_review", "image_fallback", "human_verified_image"), T.text_of(b["clean_crop_asset"])).otherwise("")


def lifecycle(version: Column, existing: Column, title: Column, text: Column) -> Column:
    """Stored blocks as they are (version 1), cut to the question (version 2), or built from the text."""
    return F.when((version == 2) & existing.isNotNull(), question_only(existing, title)).when((version == 1) & existing.isNotNull(), existing).otherwise(build(text))


# ---- alignment of formulas with recognised lines: sequential, so whole pages go through an Arrow function


def _folded(text: str) -> tuple[str, list[int]]:
    """The text in compatibility form, lower case, without spaces, and each character's place in the original."""
    pairs = [(c, i) for i, ch in enumerate(text) for c in unicodedata.normalize("NFKC", ch).lower() if not c.isspace()]
    return "".join(c for c, _ in pairs), [i for _, i in pairs]


def _near_miss(want: str, have: str) -> bool:
    """Whether `have` differs from `want` only by a few letters taken for digits."""
    wrong = [(w, h) for w, h in zip(want, have, strict=True) if w != h]
    return 0 < len(wrong) <= max(1, round(len(want) * 0.08)) and all(h in CONFUSIONS.get(w, "") for w, h in wrong)


def formula_span(line: str, visible: str, middle: float) -> tuple[int, int] | None:
    """Where a formula's visible text stands in a line: the match nearest to `middle` (0 to 1) of the line's width."""
    want, (have, place) = _folded(visible)[0], _folded(line)
    if not want or len(have) < len(want):
        return None
    n = len(want)
    found = [i for i in range(len(have) - n + 1) if have.startswith(want, i)]
    exact, i = [], -1
    while found and (i := have.find(want, (exact[-1] + n) if exact else 0)) >= 0:
        exact.append(i)
    found = exact or [i for i in range(len(have) - n + 1) if _near_miss(want, have[i : i + n])]
    if not found:
        return None
    at = min(found, key=lambda i: abs((i + n / 2) / max(1, len(have)) - min(1.0, max(0.0, middle))))
    return place[at], place[at + n - 1] + 1


MERGED = "page_id string, seq int, type string, text string, formula_id string, row_index int, baseline_y int, display boolean, alignment string"


def merge_page(lines: pd.DataFrame, formulas: pd.DataFrame) -> pd.DataFrame:
    """One page's lines and formulas as ordered blocks in rows.

    Lines have text and pixel box x0, y0, x1, y1; formulas the same with formula_id,
    latex and visible. A formula found in its line's text parts it; single letters
    stay text; what is not found stands for itself.
    """
    parts: list[dict] = []
    formulas = formulas.to_dict("records")
    state: dict[str, str] = {}
    heights = []
    for k, line in enumerate(lines.to_dict("records")):
        text = (line["text"] or "").strip()
        box = [line[c] for c in ("x0", "y0", "x1", "y1")]
        if not text or box[2] <= box[0] or box[3] <= box[1]:
            continue
        heights.append(max(1, box[3] - box[1]))
        spans = []
        for f in sorted((f for f in formulas if min(box[2], f["x1"]) > max(box[0], f["x0"]) and min(box[3], f["y1"]) > max(box[1], f["y0"])), key=lambda f: f["x0"]):
            if len(w := _folded(f["visible"])[0]) == 1 and w in "abcdefghijklmnopqrstuvwxyz0123456789":
                state[f["formula_id"]] = "text_preserved"
                continue
            span = formula_span(text, f["visible"], ((f["x0"] + f["x1"]) / 2 - box[0]) / max(1, box[2] - box[0]))
            if span is None:
                state.setdefault(f["formula_id"], "unaligned")
            else:
                state[f["formula_id"]] = "aligned"
                spans.append((*span, f))
        at, x = 0, box[0]
        for a, b, f in sorted(spans, key=lambda s: s[:2]):
            a = max(at, a)
            if a > at:
                parts.append({"box": [x, box[1], f["x0"], box[3]], "text": text[at:a], "id": f"text-{k}-{at}"})
            at, x = max(a, b), f["x1"]
        if at < len(text):
            rest = text[at:]
            if spans and "=" in (max(spans, key=lambda s: s[:2])[2]["latex"] or ""):
                cut = len(rest) - len(rest.lstrip(".。．oO"))
                rest = rest[cut:] if rest[cut : cut + 1] in (",", "，") and rest[cut : cut + 1] else rest
            parts.append({"box": [x, *box[1:]], "text": rest, "id": f"text-{k}-{at}" if spans else f"text-{k}"})
    usual = float(np.median(heights)) if heights else 20.0
    for f in formulas:
        state.setdefault(f["formula_id"], "standalone")
        if state[f["formula_id"]] != "text_preserved":
            parts.append({"box": [f[c] for c in ("x0", "y0", "x1", "y1")], "formula": f, "id": f["formula_id"]})
    found: list[list[dict]] = []
    for p in sorted(parts, key=lambda p: (p["box"][1], p["box"][0], p["id"])):
        y0, y1 = p["box"][1], p["box"][3]
        for row in reversed(found):
            top, low = min(q["box"][1] for q in row), max(q["box"][3] for q in row)
            shared = max(0, min(low, y1) - max(top, y0)) / max(1, min(low - top, y1 - y0))
            if abs(float(np.median([q["box"][1] for q in row])) - y0) <= 0.8 * usual or (shared >= 0.5 and abs((top + low) / 2 - (y0 + y1) / 2) <= 0.45 * usual):
                row.append(p)
                break
        else:
            found.append([p])
    out = []
    for r, row in enumerate(sorted(found, key=lambda row: (min(p["box"][1] for p in row), min(p["box"][0] for p in row)))):
        for p in sorted(row, key=lambda p: (p["box"][0], p["box"][1], p["id"])):
            if f := p.get("formula"):
                out.append(("latex", None, f["formula_id"], r, max(q["box"][3] for q in row), len(row) == 1 or p["box"][3] - p["box"][1] > 2.5 * usual, state[f["formula_id"]]))
            elif p["text"].strip():
                out.append(("text", p["text"].strip(), None, r, None, None, None))
    return pd.DataFrame([(i, *o) for i, o in enumerate(out)], columns=["seq", "type", "text", "formula_id", "row_index", "baseline_y", "display", "alignment"])


def merge_components(lines: DataFrame, formulas: DataFrame) -> DataFrame:
    """Blocks of every page (`page_id`) from its lines and formulas; a page is one group."""

    def run(key, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        made = merge_page(a, b)
        made.insert(0, "page_id", key[0])
        return made

    return lines.groupBy("page_id").cogroup(formulas.groupBy("page_id")).applyInPandas(run, MERGED)


def assemble(merged: DataFrame, formulas: DataFrame, texts: DataFrame) -> DataFrame:
    """`page_id`, `version` and `blocks` of each page in `texts` (page_id, text).

    Pages whose formulas all found their place get the merged blocks (version
    2); where one is unaligned, or there are none, blocks come from the text
    (version 1). `formulas` has page_id, formula_id, latex, recognition_state
    and clean_crop_asset. A page's blocks are one array.
    """
    f = formulas.select("page_id", "formula_id", F.col("latex").alias("__latex"), F.col("recognition_state").alias("__state"), F.col("clean_crop_asset").alias("__crop"))
    b = block("", text=F.col("text"), latex=F.col("__latex"), display=F.col("display"), row_index=F.col("row_index"), formula_id=F.col("formula_id"), recognition_state=F.col("__state"), clean_crop_asset=F.col("__crop")).withField("type", F.col("type"))
    pages = merged.join(f, ["page_id", "formula_id"], "left").groupBy("page_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("seq", b.alias("b")))), lambda x: x["b"]).alias("__blocks"),
        F.max(F.coalesce(F.col("alignment") == "unaligned", F.lit(False))).alias("__bad"),
        F.max(F.col("type") == "latex").alias("__some"),
    )
    good = F.coalesce(~F.col("__bad") & F.col("__some"), F.lit(False))
    return texts.join(pages, "page_id", "left").select("page_id", F.when(good, 2).otherwise(1).alias("version"), F.when(good, F.col("__blocks")).otherwise(build(F.col("text"))).alias("blocks"))
