"""Taxonomy, catalogue, review and their writes as snapshots."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from folioflow.functions import text as T
from folioflow.operators import catalog as C
from folioflow.operators import review as V
from folioflow.operators import taxonomy as Y
from folioflow.sources import files, schema


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


def test_seed_usage_and_views(spark):
    flat = Y.seed(spark)
    used = spark.createDataFrame([("计数", "染色问题"), ("计数", "染色问题"), ("计数", "老题型"), ("新组", "x")], "category_group string, category_key string")
    out = {(r["group_name"], r["category_name"]): (r["category_usage"], r["group_usage"]) for r in Y.usage_rollup(flat, Y.usage(used)).collect()}
    assert out["计数", "染色问题"] == (2, 2) and out["组合", "抽屉原理"] == (0, 0)
    assert Y.violations(flat).isEmpty()
    both = Y.with_historical(flat, used)
    old = rows(both.where("category_source = 'historical'").select("group_name", "category_name", "category_active", "group_active", "category_pos"), "group_name")
    assert old == [("新组", "x", False, False, 0), ("计数", "老题型", False, True, 6)]
    assert Y.active(both).count() == flat.count() and Y.active(both, builtin_only=True).count() == flat.count()
    again = Y.with_historical(both, used)
    assert again.count() == both.count()


def test_nested_document_and_back(spark):
    flat = Y.seed(spark)
    doc = Y.nest(flat).orderBy("group_pos").select(F.lit(1).alias("version"), F.lit(0).alias("revision"), F.struct("id", "name", "source", "active", "categories").alias("g")).groupBy("version", "revision").agg(F.collect_list("g").alias("groups"))
    back = Y.flatten(doc)
    assert rows(back.select("group_name", "category_name"), "group_name", "category_name") == rows(flat.select("group_name", "category_name"), "group_name", "category_name")


def test_update_only_adds_and_toggles(spark):
    flat = Y.seed(spark)
    new_id = lambda kind, name: F.concat(F.lit(f"custom-{kind}-"), F.sha2(name, 256))
    more = flat.unionByName(spark.createDataFrame([(None, "ＡＢ", None, True, 9, None, "题型１２", None, True, 0)], Y.SCHEMA))
    out, revision = Y.update(flat, 0, more, 0, new_id)
    added = out.where("group_name = 'AB'").first()
    assert revision == 1 and added["category_name"] == "题型12" and added["category_id"].startswith("custom-category-") and added["group_source"] == "custom"
    with pytest.raises(Y.TaxonomyConflict):
        Y.update(flat, 1, more, 0, new_id)
    with pytest.raises(Y.TaxonomyError, match="removed"):
        Y.update(flat, 0, flat.where("category_name <> '染色问题'"), 0, new_id)
    renamed = flat.withColumn("category_name", F.when(F.col("category_name") == "染色问题", "x").otherwise(F.col("category_name")))
    with pytest.raises(Y.TaxonomyError):
        Y.update(flat, 0, renamed, 0, new_id)
    off = flat.withColumn("group_active", F.lit(False))
    with pytest.raises(Y.TaxonomyError, match="inactive group"):
        Y.update(flat, 0, off, 0, new_id)
    both_off = off.withColumn("category_active", F.lit(False))
    assert Y.update(flat, 0, both_off, 0, new_id)[1] == 1


def test_deactivated_pairs_become_uncategorised(spark):
    flat = Y.seed(spark).withColumn("category_active", F.col("category_name") != "染色问题")
    p = spark.createDataFrame([(1, "计数", "染色问题", ["a"]), (2, "组合", "抽屉原理", [])], "id int, category_group string, category_key string, review_reasons array<string>")
    out = rows(Y.deactivated_override(p, flat, "停用").select("id", "category_key", "review_reasons"), "id")
    assert out == [(1, T.UNCATEGORIZED, ["a", "停用"]), (2, "抽屉原理", [])]


def test_batch_status_in_order_of_precedence(spark):
    b = spark.createDataFrame([(c,) for c in "abcde"], "id string")
    p = spark.createDataFrame([("a", "queued", "pending"), ("b", "failed", "pending"), ("c", "failed", "accepted"), ("d", "ready", None)], "batch_id string, status string, review_status string")
    assert rows(C.batch_status(b, p), "batch_id") == [("a", "processing"), ("b", "needs_review"), ("c", "partial"), ("d", "ready"), ("e", "empty")]


def test_pages_put_nulls_at_the_old_end(spark):
    df = spark.createDataFrame([(1, None), (2, "b"), (3, "a"), (4, "a")], "id int, t string")
    assert [r["id"] for r in C.page(df, "t", "id", "newest", 10).collect()] == [2, 4, 3, 1]
    assert [r["id"] for r in C.page(df, "t", "id", "whatever", 2, 1).collect()] == [3, 4]
    for bad in ({"limit": 0}, {"limit": 101}, {"offset": -1}):
        with pytest.raises(ValueError):
            C.page(df, "t", "id", **bad)
    assert C.check_page("newest", 1, 0, "  ") is None and C.check_page("oldest", 1, 0, " x ") == "x"


def test_filters_must_be_known(spark):
    flat, used = Y.seed(spark), spark.createDataFrame([("老", "x")], "category_group string, category_key string")
    assert C.known_pair(None, None, flat, used) and C.known_pair("计数", None, flat, used) and C.known_pair("老", "x", flat, used)
    assert not C.known_pair(None, "x", flat, used) and not C.known_pair("计数", "x", flat, used)


def test_publish_replaces_the_same_content(spark):
    old = spark.createDataFrame([("a", "f1"), ("b", "f2")], "id string, content_fingerprint string")
    new = spark.createDataFrame([("c", "f1", 1), ("d", "f1", 2), ("b", "f2", 1)], "id string, content_fingerprint string, at int")
    out = rows(C.publish(old, new, ["at"]).select("id", "content_fingerprint", "replaced_ids"), "id")
    assert out == [("b", "f2", []), ("d", "f1", ["a"])]


def test_asset_migration(spark):
    ddl = "id string, updated_at string, accepted_at string, review_status string, asset_state string, ocr_text string, figure string, selected_artifact string, selected_kind string, content_fingerprint string"
    df = spark.createDataFrame(
        [("a", "1", None, "accepted", "workbench", "Ｘ题", "none", "p/cleaned.png", "", None), ("b", "2", None, "accepted", "workbench", "x 题", "", "question.png", "", None), ("c", "3", "3", "pending", "published", "y", "none", None, "k", "old"), ("d", "4", None, None, "workbench", "z", None, None, None, None)], ddl
    )
    out = {r["id"]: r for r in C.migrate_assets(df).collect()}
    assert sorted(out) == ["b", "c", "d"] and (out["b"]["asset_state"], out["b"]["accepted_at"], out["b"]["selected_kind"]) == ("published", "2", "reconstructed")
    assert (out["c"]["asset_state"], out["c"]["content_fingerprint"], out["c"]["accepted_at"]) == ("workbench", None, None)


def test_compare_and_swap(spark):
    now = spark.createDataFrame([("a", 1, "x"), ("b", 1, "x"), ("c", 1, "x"), ("d", None, "x")], "id string, v int, s string")
    asked = spark.createDataFrame([("a", 1, 2, "y"), ("a", 1, 3, "z"), ("b", 9, 2, "y"), ("e", 1, 2, "y"), ("d", None, 2, "y")], "id string, expected int, new_version int, s string")
    out = rows(C.apply_cas(now, asked, "id", "v", ["s"]), "id")
    assert out == [("a", 2, "y", "applied", 1), ("b", 1, "x", "conflict", 1), ("c", 1, "x", "unchanged", 0), ("d", None, "x", "missing", 1), ("e", None, None, "missing", 1)]


def test_updates_deletes_and_children(spark):
    p = spark.createDataFrame([("a", "s", "t", "1"), ("b", "s", None, "1")], "id string, source_path string, ocr_text string, updated_at string")
    out = rows(C.apply_updates(p, spark.createDataFrame([("a", "u", "no")], "id string, ocr_text string, source_path string"), "id", F.lit("2")), "id")
    assert out == [("a", "s", "u", "2"), ("b", "s", None, "1")]
    left, gone = C.delete(p.withColumn("selected_artifact", F.lit(None).cast("string")), spark.createDataFrame([("a",)], "id string"))
    assert rows(left.select("id")) == [("b",)] and rows(gone) == [("a", "s")]
    regions = spark.createDataFrame([("a", "L2", "x", 2), ("a", "L1", "y", 1)], "parent_id string, split_label string, split_ocr_text string, top int")
    kids = rows(C.split_children(p, regions, ["top"]).select("id", "parent_source_id", "page_index", "page_total", "split_label", "source_path"), "id")
    assert kids == [("a-01", "a", 1, 2, "L1", "s"), ("a-02", "a", 2, 2, "L2", "s"), ("b", None, None, None, None, "s")]
    known = spark.createDataFrame([("1", "n", "", "0")], "id string, name string, description string, created_at string")
    names = C.ensure_categories(spark.createDataFrame([("n",), (" m ",), ("",), (None,), ("m",)], "name string"), known, F.lit("9"))
    assert sorted(r["name"] for r in names.collect()) == ["m", "n"]
    assert "source_path" not in C.public_view(p.withColumns({"category_group": F.lit("g"), "category_key": F.lit("k"), "selected_artifact": F.lit("x")})).columns


def test_diagnostics(spark):
    def say(reasons, error=None, status=None, first=(), second=()):
        df = spark.createDataFrame([(list(reasons), list(first), list(second), error, status)], "r array<string>, a array<string>, b array<string>, e string, s string")
        return [tuple(d) for d in df.select(V.diagnostics(*(F.col(c) for c in "rabes")).alias("d")).first()["d"]]

    assert say([V.REASON_HIDDEN, " "]) == []
    (only,) = say([T.REASON_NUMBERS], first=["2", "5"], second=["3"])
    assert only[0] == "critical" and "['2', '5']" in only[2] and "['3']" in only[2]
    assert [d[0] for d in say([V.REASON_NO_TRUTH, "Formula 1 requires review", "Formula 2 has no safe LaTeX result", "重建题干过短", "别的"], "E: x")] == ["warning", "warning", "warning", "critical", "warning", "critical"]
    assert say(["别的"], status="accepted") == []


def test_reasons_gates_and_states(spark):
    df = spark.createDataFrame([(["b", "a"], ["a"])], "r array<string>, o array<string>")
    out = df.select(V.resolve_reasons(F.col("r"), F.col("o")).alias("x"), V.status_decision(F.col("r"), F.lit("")).alias("s"), V.quality_gate(F.array().cast("array<string>"), F.lit(False)).alias("g")).first()
    assert tuple(out["x"]) == ([], ["a", "b"], True) and tuple(out["s"]) == ("needs_review", "pending", None)
    assert out["g"]["gate"] == "manual_review_required"
    b = spark.createDataFrame([([("latex", "needs_review")],), ([("text", None)],), (None,)], "b array<struct<type:string,recognition_state:string>>")
    assert [r[0] for r in b.select(F.coalesce(V.has_unresolved(F.col("b")), F.lit(False))).collect()] == [True, False, False]
    fixed = spark.createDataFrame([([T.REASON_NO_NUMBER, "x"], "【例题1】", 0.9), ([T.REASON_NUMBERS, V.REASON_HIDDEN, "k"], "t", 0.41)], "r array<string>, t string, s double")
    assert [r[0] for r in fixed.select(V.repair_reasons(F.col("r"), F.col("t"), F.col("s"))).collect()] == [[V.REASON_HIDDEN, "x"], ["k"]]


def test_formula_edits_are_all_or_nothing(spark):
    from folioflow.operators import latex as L

    f = spark.createDataFrame([("p", "f1", "a", "needs_review"), ("p", "f2", "b", "image_fallback"), ("q", "f1", "c", "needs_review")], "problem_id string, formula_id string, latex string, recognition_state string")
    e = spark.createDataFrame([("p", "f1", "x", False), ("p", "f2", None, True), ("q", "f1", "\\input{x}", False), ("q", "f9", "y", False)], "problem_id string, formula_id string, latex string, as_image boolean")
    out, refused = V.edit_formulas(f, e, L.valid)
    assert rows(out, "problem_id", "formula_id") == [("p", "f1", "x", "human_verified"), ("p", "f2", "b", "human_verified_image"), ("q", "f1", "c", "needs_review")]
    assert rows(refused, "problem_id", "formula_id") == [("q", "f1", "invalid"), ("q", "f9", "unknown")]
    kept = rows(V.carry_over(f, out), "problem_id", "formula_id")
    assert kept[0][2:] == ("x", "human_verified") and kept[2][2:] == ("c", "needs_review")


def test_review_outcomes(spark):
    p = spark.createDataFrame([(i, "计数", "染色问题", "pending", "1", i == 3) for i in range(1, 6)], "id int, category_group string, category_key string, review_status string, updated_at string, unresolved boolean")
    a = spark.createDataFrame([(1, "accept", "1", None, None), (2, "accept", "0", None, None), (3, "accept", "1", None, None), (4, "set_category", "1", "组合", "没有"), (5, "exclude", "0", None, None), (6, "accept", "1", None, None)], "id int, action string, expected string, group string, category_new string")
    out = {r["id"]: r["outcome"] for r in V.review(p, a, Y.active(Y.seed(spark)), F.lit("2")).collect()}
    assert out == {1: "accepted", 2: "conflict", 3: "unresolved_formula", 4: "inactive_category", 5: "excluded", 6: "missing"}


def test_schema_grows_and_constraints_hold(spark):
    old = spark.createDataFrame([("a", "b1", "计数·数位进位", '{"recognition_summary": "s"}'), ("a", "b9", None, "bad")], "id string, batch_id string, category string, metrics string")
    new = schema.evolve(old)
    assert new.columns[: len(schema.struct(schema.PROBLEMS))] == schema.struct(schema.PROBLEMS).names
    filled = schema.backfill_legacy(new).orderBy("batch_id").collect()
    assert (filled[0]["category_group"], filled[0]["category_key"], filled[0]["summary"], filled[0]["category_source"]) == ("计数", "数位进位", "s", "migrated")
    assert filled[1]["category"] == T.UNCATEGORIZED
    found = {r["rule"] for r in schema.constraint_violations(new, spark.createDataFrame([("b1",)], "id string")).collect()}
    assert found == {"primary key", "batch reference"}
    assert spark.range(1).select(schema.decode_json(F.lit("bad"), "a int").alias("x")).first()["x"]["a"] is None


def test_files_become_problems(spark, tmp_path):
    (tmp_path / "in" / "sub").mkdir(parents=True)
    (tmp_path / "in" / "sub" / "q.PNG").write_bytes(b"x")
    (tmp_path / "in" / "no.txt").write_bytes(b"x")
    found = files.images(spark, str(tmp_path / "in"))
    assert found.count() == 1
    p = files.ingest(found, F.lit("b"), F.lit("0"), str(tmp_path / "in")).first()
    assert (p["filename"], p["source_relative_path"], p["status"], p["batch_id"]) == ("q.PNG", "sub/q.PNG", "queued", "b") and len(p["source_sha256"]) == 64
    assert spark.range(1).select(files.reject_reason(F.lit("a.gif"), F.lit(1)), files.reject_reason(F.lit("a.jpg"), F.lit(31 << 20))).first()[:] == ("suffix", "too large")


def test_taxonomy_file_falls_back(spark, tmp_path):
    good = {"version": 1, "revision": 3, "groups": [{"id": "g", "name": "组", "source": "custom", "active": True, "categories": [{"id": "c", "name": "类", "source": "custom", "active": True}]}]}
    (tmp_path / "bad.json").write_text("{")
    (tmp_path / "good.json").write_text(json.dumps(good, ensure_ascii=False))
    flat, why = files.taxonomy(spark, str(tmp_path / "good.json"))
    assert why is None and flat.first()["category_name"] == "类"
    flat, why = files.taxonomy(spark, str(tmp_path / "bad.json"), str(tmp_path / "good.json"))
    assert why and flat.count() == 1
    flat, why = files.taxonomy(spark, str(tmp_path / "none.json"))
    assert why and flat.count() == Y.seed(spark).count()
    (tmp_path / "m.json").write_text(json.dumps({"schema_version": 1, "models": [{"id": "m", "weight_file": "w.bin", "weight_bytes": 1, "weight_sha256": "2d711642b726b04401627ca9fbac32f5c8530fb1903cc4db02258717921a4881"}]}))
    (tmp_path / "w.bin").write_bytes(b"x")
    models = files.verified_models(files.manifest(spark, str(tmp_path / "m.json")), spark.read.format("binaryFile").load(str(tmp_path / "w.bin")))
    assert models.first()["verified"] is True
