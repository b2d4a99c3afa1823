"""Exports: who is eligible, the outline, page layout, names, and the Markdown archive."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioflow.functions import text as T

# Fixed values of the printed layouts.
CODE_ALPHABET = "23456789ABCDEFGHJKMNPQRSTUVWXYZ"
NAME_BYTES = 130
PAGE_MM = (210.0, 297.0)
MARGIN_MM = 15.0
SLOT_MM = 118.0
ANSWER_SPACE = '<div class="mb-answer-space mb-normal"></div>'
PAGE_BREAK = '<div class="mb-page-break"></div>'
PRINT_HELP = '<div class="mb-print-help">打印前请在 Obsidian 中启用 `{brand}-print.css` 样式片段。</div>'
PRINT_CSS = """@media print {
  @page { size: A4; margin: 15mm; }
  body { font-size: 11pt; line-height: 1.5; }
  .mb-answer-space { height: 60mm; }
  .mb-answer-space.mb-long { height: 100mm; }
  .mb-page-break { break-after: page; page-break-after: always; }
  .mb-print-help { display: none !important; }
  img { max-width: 180mm; max-height: 68mm; object-fit: contain; }
}
"""


def _given(c: str) -> Column:
    return T.text_of(F.col(c)) != ""


def _settled() -> Column:
    return F.coalesce(F.col("status") == "ready", F.lit(False)) | F.coalesce(F.col("review_status") == "accepted", F.lit(False))


def pdf_eligible() -> Column:
    return _given("selected_artifact") & _given("category") & _given("ocr_text") & _settled()


def docx_eligible() -> Column:
    return _given("selected_artifact") & _given("category_group") & _given("category_key") & F.coalesce(F.col("category") == F.col("category_key"), F.lit(False)) & _given("ocr_text") & _settled()


def markdown_eligible() -> Column:
    """Accepted reconstructions with their picture, tags, text and a date."""
    name = F.element_at(F.split(T.text_of(F.col("selected_artifact")), "/"), -1)
    dated = F.col("accepted_at").isNotNull() | F.col("updated_at").isNotNull()
    return F.coalesce(F.col("review_status") == "accepted", F.lit(False)) & F.coalesce(F.col("selected_kind") == "reconstructed", F.lit(False)) & (name == "question.png") & _given("category_group") & _given("category_key") & _given("ocr_text") & dated


class NotExportable(ValueError):
    """Rows are not eligible (with their number), or none is."""


def strict_or_partial(df: DataFrame, eligible: Column, partial: bool = False) -> DataFrame:
    """The eligible rows; raises where others exist, unless `partial`, and where none is eligible. One pass counts both."""
    n = df.agg(F.count_if(eligible).alias("ok"), F.count_if(~eligible).alias("skipped")).first()
    if n["skipped"] and not partial:
        raise NotExportable(f"{n['skipped']} problems are not eligible")
    if not n["ok"]:
        raise NotExportable("no problem is eligible")
    return df.where(eligible)


def outline(df: DataFrame, order: list[str], by: list[str] | None = None) -> DataFrame:
    """`df` with export_group, export_category, number and break_after.

    Groups, and categories in them, stand in order of first appearance; numbers
    run through; a page breaks after every second problem but the last. `by`
    numbers several exports apart: within one of them the window is a document's
    size, and a whole table is never numbered in one task unless it is one export.
    """
    key = by or []
    group = F.when(_given("category_group"), F.col("category_group")).otherwise(T.UNCATEGORIZED)
    category = F.when(_given("category_key"), F.col("category_key")).when(_given("category") if "category" in df.columns else F.lit(False), F.col("category") if "category" in df.columns else F.lit("")).otherwise(T.UNCATEGORIZED)
    named = df.withColumns({"export_group": group, "export_category": category})
    at = F.row_number().over(Window.partitionBy(*key).orderBy(*order))
    placed = named.withColumn("__at", at)
    placed = placed.withColumns({"__g": F.min("__at").over(Window.partitionBy(*key, "export_group")), "__c": F.min("__at").over(Window.partitionBy(*key, "export_group", "export_category"))})
    number = F.row_number().over(Window.partitionBy(*key).orderBy("__g", "__c", "__at"))
    total = F.count("*").over(Window.partitionBy(*key))
    return placed.withColumn("number", number).withColumn("break_after", (F.col("number") % 2 == 0) & (F.col("number") < total)).drop("__at", "__g", "__c")


def top_groups(df: DataFrame, by: list[str], group: str, most: int = 3) -> DataFrame:
    """Per `by` the largest groups (count, then name) as `parts` array<struct<name, n>> and how many `remain`."""
    n = df.groupBy(*by, F.when(T.text_of(F.col(group)) == "", T.UNCATEGORIZED).otherwise(F.col(group)).alias("name")).agg(F.count("*").alias("n"))
    ranked = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("o"), "name", "n")))  # group names, not rows
    return n.groupBy(*by).agg(ranked.alias("all")).select(*by, F.transform(F.slice("all", 1, most), lambda x: F.struct(x["name"].alias("name"), x["n"].alias("n"))).alias("parts"), F.greatest(F.size("all") - most, F.lit(0)).alias("remain"))


def export_basename(parts: Column, remain: Column, at: Column, code: Column) -> Column:
    """yyyyMMdd-HHmm, the top groups with counts and how many remain, and a four-character code."""
    names = F.transform(parts, lambda p: F.concat(p["name"], p["n"].cast("string")))
    listed = F.concat(names, F.when(remain > 0, F.array(F.concat(F.lit("等"), remain.cast("string"), F.lit("类")))).otherwise(F.array().cast("array<string>")))
    summary = F.when(F.size(listed) == 0, f"{T.UNCATEGORIZED}0").otherwise(F.array_join(listed, "-"))
    return F.concat_ws("-", F.date_format(at, "yyyyMMdd-HHmm"), T.trim_utf8(summary, NAME_BYTES), code)


def valid_code(code: Column) -> Column:
    return code.rlike(f"^[{CODE_ALPHABET}]{{4}}$")


PDF_LAYOUT = "number int, page int, y_mm double, section string, new_section boolean"


def pdf_layout(outlined: DataFrame, by: str) -> DataFrame:
    """`by`, number, page, y and section of each problem of each export on A4 pages after the contents page.

    At most two problems a page; where each stands depends on all before it in
    its own export, so each export is folded in turn.
    """

    def run(key, rows: pd.DataFrame) -> pd.DataFrame:
        top, bottom = PAGE_MM[1] - MARGIN_MM, MARGIN_MM
        page, y, held, before, out = 2, top, 0, None, []
        for r in rows.sort_values("number").itertuples():
            section = f"{r.export_group} / {r.export_category}"
            new = section != before
            if new:
                if held >= 2 or (y < top and y < 42):
                    page, y, held = page + 1, top, 0
                elif y < top:
                    y -= 5
                y -= 14
            if held >= 2 or y - SLOT_MM < bottom:
                page, y, held = page + 1, top - 10, 0
            out.append((key[0], int(r.number), page, y, section, new))
            y, held, before = y - SLOT_MM, held + 1, section
        return pd.DataFrame(out, columns=[by, "number", "page", "y_mm", "section", "new_section"])

    kind = outlined.schema[by].dataType.simpleString()
    return outlined.select(by, "number", "export_group", "export_category").groupBy(by).applyInPandas(run, f"{by} {kind}, {PDF_LAYOUT}")


def docx_layout(outlined: DataFrame) -> DataFrame:
    """One row per paragraph: order key, style and text; a heading where a group or category begins."""
    w = Window.partitionBy("batch_id").orderBy("number")
    new_group = ~F.col("export_group").eqNullSafe(F.lag("export_group").over(w))
    new_category = new_group | ~F.col("export_category").eqNullSafe(F.lag("export_category").over(w))
    row = lambda rank, style, text, when: F.when(when, F.struct(F.lit(rank).alias("rank"), F.lit(style).alias("style"), text.alias("text")))
    title = T.display_title(F.col("title"), F.col("ocr_text"), F.col("number"), 24)
    parts = F.array_compact(F.array(row(1, "Heading 1", F.col("export_group"), F.col("__g")), row(2, "Heading 2", F.col("export_category"), F.col("__c")), row(3, "Heading 3", title, F.lit(True)), row(4, "Normal", T.text_of(F.col("ocr_text")), F.lit(True)), row(5, "Space 45mm", F.lit(""), F.lit(True)), row(6, "Page break", F.lit(""), F.col("break_after"))))
    return outlined.withColumns({"__g": new_group, "__c": new_category}).select("batch_id", "number", F.explode(parts).alias("p")).select("batch_id", "number", "p.rank", "p.style", "p.text")


def attachments(df: DataFrame, assets: str = "assets") -> DataFrame:
    """`id`, `image_index`, `asset` and `name` of each problem's pictures in order (`assets` array<string>)."""
    return df.select("id", F.posexplode(assets).alias("i", "asset")).select("id", (F.col("i") + 1).alias("image_index"), "asset", T.attachment_name(F.col("id").cast("string"), F.col("i") + 1).alias("name"))


def duplicate_attachments(names: DataFrame) -> DataFrame:
    return names.groupBy("name").count().where("count > 1").select("name")


def safe_resource(asset: Column) -> Column:
    """Whether an asset is a bare file name."""
    return (T.text_of(asset) != "") & ~asset.contains("/") & ~asset.contains("\\") & ~asset.isin(".", "..")


def markdown_lines(outlined: DataFrame) -> DataFrame:
    """The note's body as rows: batch_id, part (0 contents, 1 body), number, rank, line.

    `outlined` is an `outline` by batch with `title`, `id` and `body` (rendered
    blocks, an array of lines). Links and targets come from the same ids.
    """
    w = Window.partitionBy("batch_id").orderBy("number")
    o = outlined.withColumns({"__ng": ~F.col("export_group").eqNullSafe(F.lag("export_group").over(w))})
    o = o.withColumn("__nc", F.col("__ng") | ~F.col("export_category").eqNullSafe(F.lag("export_category").over(w)))
    g, c, pid = F.col("export_group"), F.col("export_category"), F.col("id").cast("string")
    title = T.display_title(F.col("title"), F.col("ocr_text"), F.col("number"))
    ids = (T.anchor_id(F.lit("group"), g), T.anchor_id(F.lit("category"), g, c), T.anchor_id(F.lit("problem"), pid))
    line = lambda part, rank, text, when=None: F.when(F.lit(True) if when is None else when, F.struct(F.lit(part).alias("part"), F.lit(rank).alias("rank"), text.alias("line")))
    link = lambda pad, anchor, name: F.concat(F.lit(f"{pad}- [[#^"), anchor, F.lit("|"), T.wikilink_alias(name), F.lit("]]"))
    head = lambda marks, name, anchor: F.concat(F.lit(f"\n{marks} "), T.escape_markdown(name), F.lit(" ^"), anchor)
    rows = F.array_compact(
        F.array(
            line(0, 0, link("", ids[0], g), F.col("__ng")), line(0, 1, link("  ", ids[1], c), F.col("__nc")), line(0, 2, link("    ", ids[2], title)),
            line(1, 0, head("##", g, ids[0]), F.col("__ng")), line(1, 1, head("###", c, ids[1]), F.col("__nc")), line(1, 2, head("####", title, ids[2])),
            line(1, 3, F.concat(F.lit("\n"), F.array_join("body", "\n"))), line(1, 4, F.lit(f"\n{ANSWER_SPACE}")), line(1, 5, F.lit(f"\n{PAGE_BREAK}"), F.col("break_after")),
        )
    )
    return o.select("batch_id", "number", F.explode(rows).alias("r")).select("batch_id", "r.part", "number", "r.rank", "r.line")


def render_blocks(blocks: Column, names: Column, title: Column) -> Column:
    """Blocks as Markdown lines: prose and inline formulas flow together, pictures and displayed formulas stand alone.

    `names` are the attachments in the order of the blocks that show a picture.
    """
    from folioflow.operators.blocks import block_asset

    state = F.struct(F.array().cast("array<string>").alias("out"), F.lit("").alias("flow"), F.lit(0).alias("images"), F.lit(True).alias("first"))

    def step(s: Column, b: Column) -> Column:
        picture = block_asset(b) != ""
        n = s["images"] + picture.cast("int")
        latex = F.trim(T.text_of(b["latex"]))
        own = T.text_of(b["text"])
        own = F.when(s["first"] & F.ltrim(own).startswith(title) & (title != ""), F.ltrim(F.substr(F.ltrim(own), F.length(title) + 1))).otherwise(own)
        shown = F.when(picture, F.concat(F.lit("![[attachments/"), F.get(names, n - 1), F.lit("]]"))).when(b["type"] == "text", T.escape_markdown(own)).when(latex == "", "").when(F.coalesce(b["display"], F.lit(False)), F.concat(F.lit("$$"), latex, F.lit("$$"))).otherwise(F.concat(F.lit("$"), latex, F.lit("$")))
        alone = (b["type"] == "image") | F.coalesce(b["display"], F.lit(False))
        done = F.when(alone & (s["flow"] != ""), F.concat(s["out"], F.array(s["flow"]))).otherwise(s["out"])
        return F.struct(
            F.when(alone & (shown != ""), F.concat(done, F.array(shown))).otherwise(done).alias("out"),
            F.when(alone, F.lit("")).otherwise(F.concat(s["flow"], shown)).alias("flow"),
            n.alias("images"),
            (s["first"] & (b["type"] != "text")).alias("first"),
        )

    return F.aggregate(blocks, state, step, lambda s: F.when(s["flow"] != "", F.concat(s["out"], F.array(s["flow"]))).otherwise(s["out"]))


def front_matter(batch_id: str, created_at: str, count: int, brand: str = "question-book", title: str = "题集") -> str:
    """A note's head; `brand` names its type, tag and style sheet, `title` stands above the contents."""
    return "\n".join(["---", f"type: {brand}", f'batch_id: "{batch_id}"', f'created_at: "{created_at}"', f"problem_count: {count}", "cssclasses:", f"  - {brand}-print", "tags:", f"  - {brand}", "---", "", f"# {title}", "", PRINT_HELP.format(brand=brand), "", f"共 {count} 道题。", "", "## 目录", ""])


def markdown_note(lines: DataFrame, batch_id: str, created_at: str, **head: str) -> str:
    """One batch's note as text; a batch is at most 200 uploaded files, so its lines fit the driver."""
    rows = lines.where(F.col("batch_id") == batch_id).orderBy("part", "number", "rank").select("line", "number").collect()
    return front_matter(batch_id, created_at, len({r["number"] for r in rows}), **head) + "\n" + "\n".join(r["line"] for r in rows).rstrip() + "\n"


def markdown_zip(note_name: str, note: str, files: Iterable[tuple[str, bytes]], brand: str = "question-book") -> bytes:
    """The archive: note, print style sheet and attachments. A repeated attachment name is an error."""
    out, seen = io.BytesIO(), set()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr(f"{note_name}.md", note)
        z.writestr(f".obsidian/snippets/{brand}-print.css", PRINT_CSS)
        for name, data in files:
            if name in seen:
                raise ValueError(f"Duplicate attachment: {name}")
            seen.add(name)
            z.writestr(f"attachments/{name}", data)
    return out.getvalue()
