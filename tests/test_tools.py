"""Dictionaries, the article store, background evaluations, the command line."""

import json

import pytest
from pyspark.sql import functions as F

from tessera import cli, jobs
from tessera.functions import chinese
from tessera.sources import tables


def test_syllables():
    got = {p: chinese.syllable(p) for p in ("zhang1", "yi4", "wu3", "yu2", "yuan2", "a1", "SHI", "yang2", "wo3", "er4")}
    assert got == {"zhang1": ("zh", "ang", "1"), "yi4": ("", "i", "4"), "wu3": ("", "u", "3"), "yu2": ("", "v", "2"), "yuan2": ("", "van", "2"), "a1": ("", "a", "1"), "SHI": ("sh", "i", "0"), "yang2": ("y", "ang", "2"), "wo3": ("w", "o", "3"), "er4": ("", "er", "4")}
    assert chinese.sound_code("zhang1") == "Z89" and chinese.sound_code("san1", True) == "S991"


def test_sounds(spark):
    lexicon = spark.createDataFrame([("張", "zhang1"), ("章", "zhang1"), ("三", "san1"), ("李", "li3")], "char string, pinyin string")
    docs = spark.createDataFrame([(1, "張三"), (2, "章三!"), (3, "李 abc 9"), (4, None), (5, "龘")], "doc_id long, text string")
    code = {r["doc_id"]: r["codes"] for r in chinese.sounds(docs, lexicon).collect()}
    assert code == {1: "Z89 S99", 2: "Z89 S99", 3: "L54 A B C", 4: "", 5: "龘"}
    pairs = spark.createDataFrame([("Z89 S99", "Z89 S99"), ("Z89 S99", "Z89 L54 A"), ("", "Z89")], "a string, b string")
    for mode, want in {"exact": [1.0, 0.0, 0.0], "fuzzy": [1.0, 1 / 3, 0.0], "weighted": [1.0, 1 / (1 + 1 / 2 + 1 / 3), 0.0]}.items():
        assert [r["s"] for r in pairs.select(chinese.sound_similarity(F.col("a"), F.col("b"), mode).alias("s")).collect()] == pytest.approx(want)


def test_segmentation(spark):
    words = spark.createDataFrame([("中文", 50), ("分詞", 40), ("文分", 1), ("資訊", 60), ("檢索", 60), ("資訊檢索", 30)], "word string, n long")
    docs = spark.createDataFrame([(1, "中文分詞"), (2, "資訊檢索 and 中X"), (3, ""), (4, None)], "doc_id long, text string")
    assert {r["doc_id"]: r["w"] for r in chinese.segmented(docs, words).collect()} == {1: ["中文", "分詞"], 2: ["資訊檢索", "and", "中", "x"], 3: [], 4: []}


def test_article_store(spark, tmp_path):
    tables.create(spark, "store", f"file://{tmp_path}/store")
    try:
        rows = spark.createDataFrame([("1", "t", "one", "s1"), ("2", "t", "two", "s2"), ("3", "t", "one", "s1")], "article_id string, title string, content string, source string")
        tables.append_new(rows, "store")
        tables.append_new(rows.withColumn("content", F.concat("content", F.when(F.col("article_id") == "2", "!").otherwise(""))), "store")
        got = spark.table("store.articles")
        assert sorted(r["content"] for r in got.collect()) == ["one", "two", "two!"]
        assert tables.columns(spark, "store").where("table = 'articles'").count() == 10
    finally:
        tables.drop(spark, "store")


def test_background_evaluations(spark):
    run = spark.createDataFrame([("q", 1, 1), ("q", 2, 2)], "query_id string, rank int, doc_id long")
    qrels = spark.createDataFrame([("q", 2, 1)], "query_id string, doc_id long, rel int")
    e = jobs.Evaluations(spark, "d1", "j1")
    calls = []
    keys = {e.submit({"model": "m", "k": 10}, lambda: calls.append(1) or run, qrels) for _ in range(3)}
    (key,) = keys
    assert e.result(key, 120)["map"] == 0.5 and e.status(key) == "done" and len(calls) == 1 and e.status("x") == "unknown"


def test_command_line(spark, sf_dir, tmp_path, capsys):
    docs = f"{sf_dir}/documents.parquet"
    stats = json.loads(cli.main(["build-index", docs, f"file://{tmp_path}/index"], spark))
    assert stats["doc_count"] == spark.read.parquet(docs).count() and stats["was_current"] is False
    lines = cli.main(["search", docs, "the thing", "--k", "3"], spark).splitlines()
    assert [json.loads(x)["rank"] for x in lines] == [1, 2, 3]
    assert len(cli.main(["search", docs, "lang:fr AND source:src1"], spark).splitlines()) >= 0
    (tmp_path / "run").write_text("q Q0 d1 1 2.0 t\nq Q0 d2 2 1.0 t\n")
    (tmp_path / "qrels").write_text("q 0 d1 1\n")
    assert json.loads(cli.main(["evaluate", f"{tmp_path}/run", f"{tmp_path}/qrels"], spark))["map"] == 1.0
    (tmp_path / "in.jsonl").write_text("\n".join(json.dumps({"title": f"title {i % 2}", "url": "u", "content": "c" * 30, "source": "s"}) for i in range(4)))
    assert json.loads(cli.main(["build-corpus", f"{tmp_path}/in.jsonl", f"{tmp_path}/corpus"], spark))["articles"] == 2
