"""Builders, search, readers, writers and streams on small fixtures."""

from __future__ import annotations

import json
import sqlite3

import pytest
from pyspark.sql import functions as F

from lexweave.functions.script import normalize
from lexweave.operators import build, extract, quality, search
from lexweave.sources import sinks, tables
from lexweave.streaming import resume


@pytest.fixture(scope="module")
def bundle(spark):
    entry = "norm string, iast string, place long, dict string, id string"
    rows = [(1, "dharma", "chos", "法", ["mahavyutpatti", "hopkins-tsed"])]
    equiv = spark.createDataFrame(rows, "row_id long, skt_iast string, tib_wylie string, zh string, sources array<string>")
    return {
        "tier0": spark.createDataFrame([("dharma", "dharma", 1, "apte", "apte-sanskrit-english-001")], entry),
        "tier0_bo": spark.createDataFrame([], entry),
        "equiv_keys": build.equivalent_keys(equiv, normalize(F.col("value"))),
        "equiv_rows": equiv,
        "reverse_en": spark.createDataFrame([("duty", 1, "apte-001"), ("duty", 2, "monier-williams-001")], "token string, rank long, id string"),
        "reverse_ko": spark.createDataFrame([("법", 1, "apte-001")], "token string, rank long, id string"),
        "headwords": spark.createDataFrame([("dharma", "dharma"), ("dharma-cakra", "dharma-cakra"), ("dharmin", "dharmin")], "norm string, iast string"),
    }


EXPECT = {
    "dharma": {"exact": 1, "equivalents": 1, "partial": 2},
    "chos": {"equivalents": 1},
    "法": {"equivalents": 1},
    "धर्म": {"exact": 1, "equivalents": 1, "partial": 2},
    "Dharma": {"exact": 1, "equivalents": 1, "partial": 2},
    "duty": {"reverse_en": 2},
    "법": {"reverse_ko": 1},
    "dh": {"partial": 3},
    "Duty": {},
    "   ": {},
    "": {},
}


def test_channels(spark, bundle):
    asked = spark.createDataFrame(list(enumerate(EXPECT)), "qid int, raw string")
    found = {}
    for r in search.search(asked, bundle).groupBy("qid", "channel").count().collect():
        found.setdefault(r["qid"], {})[r["channel"]] = r["count"]
    assert {q: found.get(k, {}) for k, q in enumerate(EXPECT)} == EXPECT


def test_prefix_limit_keeps_order(spark, bundle):
    keys = search.keyed(spark.createDataFrame([(1, "dh")], "qid int, raw string"))
    assert [r["norm"] for r in search.partial(keys, bundle["headwords"], 1).collect()] == ["dharma"]


def test_language_balance(spark):
    rows = [("a-1", "apte", "en", 1), ("m-1", "monier-pali-x", "en", 2), ("t-1", "tib-a", "bo", 3), ("t-2", "tib-b", "bo", 4), ("mw-1", "monier", "en", 5), ("t-3", "tib-c", "bo", 6), ("t-4", "tib-d", "bo", 7), ("b-1", "bopp", "la", 8), ("c-1", "capp", "de", 9)]
    e = spark.createDataFrame(rows, "id string, dict string, target_lang string, priority int").withColumn("q", F.lit(1))
    lang = search.entry_lang(F.col("dict"), F.col("target_lang"))
    top = search.balanced_top(e, lang, ["priority"], ["q"], 2)
    assert [r["id"] for r in top.orderBy("lang_rank", "place").collect()] == ["a-1", "mw-1", "t-1", "t-2", "m-1"]
    rest = search.balanced_rest(e, top, ["q"]).orderBy("priority")
    assert [r["id"] for r in rest.collect()] == ["t-3", "t-4", "b-1", "c-1"]
    flagged = search.balanced(e, lang, ["priority"], ["q"], 2).where("top").count()
    assert flagged == 5


def test_equivalents_fold(spark):
    cols = "skt_iast string, tib_wylie string, zh string, ko string, en string, ja string, de string, category string, note string, slug string, ord long"
    rows = [
        ("Dharma", "chos", "法", None, None, None, None, None, None, "a", 1),
        ("dharma ", "chos", "法", None, None, None, None, None, "longer note", "b", 2),
        ("dharma", "chos", "法", None, None, None, None, None, None, "a", 3),
        ("x", None, "latin", None, None, None, None, None, None, "c", 4),
        (None, "", None, None, "law", None, None, None, None, "c", 5),
    ]
    out = {r["row_id"]: r for r in build.equivalents(spark.createDataFrame(rows, cols)).collect()}
    assert set(out) == {1, 4}
    assert out[1]["note"] == "longer note" and out[1]["sources"] == ["a", "b"]
    assert out[4]["zh"] is None


def test_clean_headword(spark):
    cases = {"a\nb": "a", "<x>y": "<x>y", "ab{c": "ab", "\tx\ty": "x\ty", " a <b>": "a", "a<b\nc": "a"}
    rows = spark.createDataFrame([(k,) for k in cases], "x string").select("x", extract.clean_headword(F.col("x")).alias("y")).collect()
    assert {r["x"]: r["y"] for r in rows} == cases


def test_entries_keep_numbers_of_skipped_rows(spark):
    rows = spark.createDataFrame([("d", 1, 10, "prajJA", "<b>wisdom</b>; insight", ""), ("d", 2, 11, " ", "x", ""), ("d", 3, 12, "agni", "", "불")], "slug string, seq int, raw_id int, headword string, body string, body_ko string")
    dicts = spark.createDataFrame([("d", "skt", 1, 5, "pd", "xdxf", None, "d.dict")], "slug string, lang string, tier int, priority int, license string, source_format string, sense_separator string, v1_name string")
    got = extract.make_entries(rows, dicts).orderBy("id").collect()
    assert [(r["id"], r["headword_iast"], r["headword_norm"]) for r in got] == [("d-000001", "prajñā", "prajna"), ("d-000003", "agni", "agni")]
    assert got[0]["body"]["plain"] == "wisdom; insight" and got[0]["reverse"]["en"] == ["insight", "wisdom"]
    assert got[1]["flags"] == ["body-empty"] and got[1]["reverse"]["ko"] == ["불"]


def test_relocated_fields_never_overwrite(spark):
    body = "struct<plain: string, zh: string, en: string, equivalents: struct<zh: string, note: string>>"
    rows = spark.createDataFrame([(("p", "法", "law", (None, "n")),), (("p", "x", None, ("佛", None)),)], f"body {body}")
    got = [r["body"].asDict(True) for r in extract.relocated(rows).collect()]
    assert got[0]["equivalents"]["zh"] == "法" and got[0]["equivalents"]["en"] == "law" and got[0]["en"] == "law"
    assert got[1]["equivalents"]["zh"] == "佛" and "zh" not in got[1]


def test_examples_follow_last_main(spark):
    rows = [("d", 1, "main"), ("d", 2, "sub"), ("d", 3, "ex"), ("d", 4, "main"), ("d", 5, "ex"), ("e", 1, "ex")]
    got = extract.attach_examples(spark.createDataFrame(rows, "doc string, n int, kind string"), "n").orderBy("n").collect()
    assert [(r["n"], r["main"]) for r in got] == [(3, 1), (5, 4)]


def test_jsonl_skips_malformed(spark, tmp_path):
    good = {"id": "d-000001", "dict": "d", "headword": "a", "headword_iast": "a", "headword_norm": "a", "lang": "skt", "body": {"plain": "x"}, "source_meta": {"k": [1]}}
    (tmp_path / "d.jsonl").write_text(json.dumps(good) + "\n\n{broken\n" + json.dumps(good | {"id": "d-000002"}) + "\n")
    df = tables.read_entries(spark, str(tmp_path))
    assert [r["id"] for r in df.orderBy("id").collect()] == ["d-000001", "d-000002"]
    assert tables.read_entries(spark, str(tmp_path), 1).count() == 1
    bad = tables.malformed_lines(spark, str(tmp_path)).collect()
    assert [(r["lines"], r["malformed"]) for r in bad] == [(3, 1)]


def test_catalog_of_dicts(spark, tmp_path):
    for slug, priority in (("b", 2), ("a", 2), ("c", 1)):
        (tmp_path / slug).mkdir()
        (tmp_path / slug / "meta.json").write_text(json.dumps({"slug": slug, "priority": priority}, indent=1))
    df = tables.read_dicts(spark, f"{tmp_path}/*/meta.json")
    assert [r["slug"] for r in tables.by_priority(df).collect()] == ["c", "a", "b"]
    assert tables.read_dicts(spark, f"{tmp_path}/*/meta.json", ["a"]).count() == 1
    (tmp_path / "c" / "meta.json").write_text("{no")
    with pytest.raises(Exception):  # noqa: B017
        tables.read_dicts(spark, f"{tmp_path}/*/meta.json", strict=True).collect()


def test_sqlite(spark, tmp_path):
    paths = []
    for k in range(2):
        paths.append(str(tmp_path / f"{k}.sqlite"))
        with sqlite3.connect(paths[-1]) as con:
            con.execute("create table entries (id integer, dict_id integer, headword text)")
            con.executemany("insert into entries values (?, ?, ?)", [(k * 10 + j, j % 2, None if j == 0 else f"h{j}") for j in range(4)])
    rows = tables.read_sqlite(spark, paths, "select * from entries", "id long, dict_id long, headword string")
    got = tables.raw_entries(rows, [0], 1).collect()
    assert [(r["id"], r["headword"]) for r in got] == [(0, "")]


def test_append_is_resumable(spark, tmp_path):
    path = str(tmp_path / "out")
    make = lambda rows: spark.createDataFrame(rows, "entry_id string, ko string, position long")
    sinks.append_new(spark, make([("a", "1", 1), ("a", "2", 2), ("b", "", 3)]), path)
    sinks.append_new(spark, make([("b", "9", 1), ("c", "3", 2)]), path)
    got = spark.read.schema("entry_id string, ko string").json(path)
    assert sorted((r["entry_id"], r["ko"]) for r in got.collect()) == [("a", "1"), ("b", ""), ("c", "3")]


def test_rewrite_in_place(spark, tmp_path):
    path = str(tmp_path / "rows")
    spark.createDataFrame([(1,), (2,)], "x int").write.json(path)
    df = spark.read.schema("x int").json(path)
    sinks.rewrite(spark, df.withColumn("x", F.col("x") + 1), path)
    assert sorted(r["x"] for r in spark.read.schema("x int").json(path).collect()) == [2, 3]


def test_interrupted_rewrite_is_undone(spark, tmp_path):
    path, x = str(tmp_path / "rows"), "x int"
    sinks.write_jsonl(spark.createDataFrame([(1,)], x), path)
    (tmp_path / "rows").rename(tmp_path / "rows.previous")  # stopped between the two moves
    sinks.recover(spark, path)
    assert [r["x"] for r in spark.read.schema(x).json(path).collect()] == [1]
    sinks.write_jsonl(spark.createDataFrame([(2,)], x), path)
    assert [r["x"] for r in spark.read.schema(x).json(path).collect()] == [2] and not (tmp_path / "rows.previous").exists()


def test_search_over_written_indices(spark, bundle, tmp_path):
    for name, df in bundle.items():
        sinks.write_index(df, str(tmp_path / name))
    read = {name: tables.read_index(spark, str(tmp_path / name)) for name in bundle}
    asked = spark.createDataFrame(list(enumerate(EXPECT)), "qid int, raw string")
    rows = lambda b: sorted(map(str, search.search(asked, b).collect()))
    assert rows(read) == rows(bundle) and rows(bundle)
    tables.register(spark, read, "idx_")
    assert spark.table("idx_headwords").count() == 3


def test_second_tier_counts_on(spark):
    entry = "norm string, iast string, place long, dict string, id string"
    skt = spark.createDataFrame([("a", "ā", 1, "x", "x-1"), ("a", "ā", 2, "y", "y-1")], entry)
    bo = spark.createDataFrame([("a", "A", 1, "z", "z-1"), ("b", "B", 1, "z", "z-2")], entry)
    got = sorted(tuple(r) for r in search.merge_buckets(skt, bo).select("norm", "place", "iast", "id").collect())
    assert got == [("a", 1, "ā", "x-1"), ("a", 2, "ā", "y-1"), ("a", 3, "ā", "z-1"), ("b", 1, "B", "z-2")]


def test_long_prefixes_and_short_ones(spark):
    words = spark.createDataFrame([(w, w) for w in ("a", "ab", "abc", "abcd", "abcde", "abcdef", "b")], "norm string, iast string")
    for key in ("a", "ab", "abcd", "abcde", "zz"):
        keys = search.keyed(spark.createDataFrame([(1, key)], "qid int, raw string"))
        want = [w for w in ("a", "ab", "abc", "abcd", "abcde", "abcdef") if w.startswith(key)]
        for limit in (2, 20):
            got = sorted((r["rank"], r["norm"]) for r in search.partial(keys, words, limit).collect())
            assert [w for _, w in got] == want[:limit]


def test_numbers_and_records_across_ranges(spark):
    rows = spark.createDataFrame([("g" if k % 3 else "h", k * 7, k) for k in range(40)] + [(None, 5, 99)], "grp string, at long, k int")
    for width in (10, 1 << 16):
        got = {(r["grp"], r["at"]): r["seq"] for r in extract.numbered(rows, "grp", "at", width).collect()}
        for grp in ("g", "h", None):
            own = sorted(at for g, at in got if g == grp)
            assert [got[grp, at] for at in own] == list(range(1, len(own) + 1))
    lines = spark.createDataFrame([(1, k, "head" if k % 11 == 3 else "stop" if k % 11 == 8 else "line") for k in range(60)], "doc int, at int, kind string")
    head, stop = F.col("kind") == "head", F.col("kind") == "stop"
    want = sorted(map(str, extract.islands(lines, "doc", "at", head, resets=stop).collect()))
    assert sorted(map(str, extract.islands(lines, "doc", "at", head, resets=stop, width=4).collect())) == want
    record, live, expect = 0, False, []
    for k in range(60):
        kind = "head" if k % 11 == 3 else "stop" if k % 11 == 8 else "line"
        record += kind != "line"
        live = kind == "head" or (live and kind != "stop")
        if live:
            expect.append((k, record))
    got = extract.islands(lines, "doc", "at", head, resets=stop, width=4).collect()
    assert sorted((r["at"], r["record"]) for r in got) == expect


def test_last_duplicate_line_wins(spark, tmp_path):
    (tmp_path / "t").mkdir()
    for name, ko in (("a.jsonl", ["1", "2"]), ("b.jsonl", ["3", ""])):
        (tmp_path / "t" / name).write_text("".join(json.dumps({"entry_id": "x", "ko": v}) + "\n" for v in ko))
    got = tables.read_translations(tables.translation_lines(spark, str(tmp_path / "t")))
    assert [r["ko"] for r in got.collect()] == ["3"]


def test_page_cache_and_defaults(spark):
    pages = spark.createDataFrame([(1, "san", 6, 300, 2), (2, "san", 6, 300, 1), (3, "eng", 6, 300, 2)], "page int, langs string, psm int, dpi int, columns int")
    assert [r["page"] for r in tables.page_cache(pages, "san", 6, 300, 2).collect()] == [1]
    meta = spark.createDataFrame([(None, None), (["a"], {"e": ("x", 0)})], "dicts array<string>, ids map<string, struct<iast: string, dict: int>>")
    got = tables.reverse_meta_defaults(meta).collect()
    assert sorted((len(r["dicts"]), len(r["ids"])) for r in got) == [(0, 0), (1, 1)]


def test_format_rank_and_canonical(spark):
    rows = spark.createDataFrame([("a.dict", "b.apple", 1, 9), ("b", "a", 3, 3), ("a.gretil", "b", 5, 1), ("x.apple", "y.apple", 2, 5)], "a string, b string, n int, m int")
    pick = quality.canonical(F.col("a"), F.col("b"), F.col("n"), F.col("m"))
    assert [r[0] for r in rows.select(pick).collect()] == ["a.dict", "a", "b", "y.apple"]
    rank = quality.format_rank(F.col("a"), ["x.apple", "b"])
    assert [r[0] for r in rows.select(rank).collect()] == [2, 1, 2, 0]


def test_progress_of_a_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.jsonl").write_text("".join(json.dumps({"entry_id": str(k), "ko": "x" * (k % 2)}) + "\n" for k in range(5)))
    q = resume.progress(resume.arriving(spark, str(tmp_path / "in"))).writeStream.outputMode("complete").format("memory").queryName("progress").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert {r["state"]: r["n"] for r in spark.table("progress").collect()} == {"empty": 3, "translated": 2}


def test_written_forms(spark, tmp_path):
    words = spark.createDataFrame([("b", "B"), ("a", "A")], "norm string, iast string")
    sinks.write_headwords(words, str(tmp_path / "w"))
    assert [r["value"] for r in spark.read.text(str(tmp_path / "w")).orderBy("value").collect()] == ["a\tA", "b\tB"]
    sinks.write_index(words, str(tmp_path / "p"))
    assert spark.read.parquet(str(tmp_path / "p")).count() == 2
    rows = spark.range(1, 8).withColumnRenamed("id", "position")
    sinks.write_chunks(rows, str(tmp_path / "c"), 3)
    assert {r["chunk"]: r["count"] for r in spark.read.json(str(tmp_path / "c")).groupBy("chunk").count().collect()} == {1: 3, 2: 3, 3: 1}
    assert sinks.markdown(words.orderBy("norm"), "T").splitlines()[-1] == "| b | B |"


def test_stream_appends_each_id_once(spark, tmp_path):
    src, out, check = (str(tmp_path / x) for x in ("src", "out", "check"))
    write = lambda rows: spark.createDataFrame(rows, "entry_id string, ko string").coalesce(1).write.mode("append").json(src)
    write([("a", "1"), ("b", "2")])
    for extra in ([("b", "3"), ("c", "4")], []):
        resume.append_stream(resume.arriving(spark, src), out, check).awaitTermination()
        if extra:
            write(extra)
    got = spark.read.schema("entry_id string, ko string").json(out)
    assert sorted((r["entry_id"], r["ko"]) for r in got.collect()) == [("a", "1"), ("b", "2"), ("c", "4")]


def test_similarity_and_verdict(spark):
    rows = spark.createDataFrame([("abcd", "abcd"), ("abcd", "wxyz"), (None, "x")], "a string, b string")
    assert [r[0] for r in rows.select(quality.body_similarity(F.col("a"), F.col("b"))).collect()] == [1.0, 0.0, None]
    v = spark.createDataFrame([(0.95, 0.9), (0.95, 0.1), (0.5, 1.0), (0.4, 1.0)], "j double, s double")
    assert [r[0] for r in v.select(quality.verdict(F.col("j"), F.col("s"))).collect()] == ["STRICT_DUPLICATE", "PARTIAL_DUPLICATE", "PARTIAL_DUPLICATE", "DIFFERENT"]


def test_top_k_limit_is_pushed_before_the_shuffle(spark):
    tokens = spark.createDataFrame([("t", 0, 1, "h", "i")], "token string, pos int, priority int, headword string, id string")
    plan = build.reverse_lists(tokens)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def test_prefix_filter_reaches_the_scan(spark, tmp_path):
    path = str(tmp_path / "w")
    spark.createDataFrame([("dharma", "d")], "norm string, iast string").write.parquet(path)
    plan = search.prefix_lookup(spark.read.parquet(path), "dh")._jdf.queryExecution().executedPlan().toString()
    assert "StringStartsWith(norm,dh)" in plan


def test_missing_package_does_not_break_entry(monkeypatch):
    import importlib

    import __spark_entry__

    monkeypatch.setattr(importlib.util, "find_spec", lambda name: None)
    assert "reverse_topk" in __spark_entry__.queries() and not any(k.startswith("op") for k in __spark_entry__.queries())


def test_declension_lookup(spark):
    index = spark.createDataFrame([("deva", "deva", "[Mas.] deva Masculine Singular Dual Plural Nominative devaḥ devau devāḥ", "h"), ("deva", "deva", "plain", "h")], "norm string, iast string, body string, dict string")
    asked = spark.createDataFrame([(1, "देव"), (2, "x"), (3, "")], "qid int, raw string")
    got = sorted(search.declension_lookup(asked, index).collect(), key=lambda r: r["raw"] or "")
    assert [(r["qid"], r["raw"]) for r in got] == [(1, None), (1, "plain")] and got[0]["grid"]["gender"] == "Masculine"
