"""Languages of texts: held-out accuracy, whole texts, awkward rows."""

import numpy as np
from pyspark.sql import functions as F

from llm_cases import AWKWARD, docs
from meterline.llm import QUERIES, langid

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    got = QUERIES["op13_language_id"](spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet"), "doc_id")
    right = got.where("held_out and lang is not null").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert right >= 0.97
    assert got.where("score < 0 or score > 1 or score is null or lang_pred is null").count() == 0


def labelled(spark):
    words = {"xx": "brin stok klau fren", "yy": "aloe eira oumia ileo"}
    rng = np.random.default_rng(0)
    rows = [(i, " ".join(rng.permutation(words[lang].split() * 20)), lang) for i, lang in enumerate(["xx", "yy"] * 40)]
    rows += [(100, None, "xx"), (101, "brin", None), (102, "12 34", "yy"), (None, "stok stok", "xx")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def test_whole_texts_and_awkward_rows(spark):
    network = langid.learn(labelled(spark), epochs=20)
    assert network.languages == ("xx", "yy")
    late = "brin stok " * 20 + "aloe eira " * 4_000
    rows = [*AWKWARD, (20, late), (21, "AlOE EIRA"), (22, "0123 ... \t"), (23, "\x00\x00a"), (24, late)]
    table = docs(spark, rows).withColumn("lang_pred", F.lit("extra"))
    got = {r.doc_id: r for r in langid.identify(table, network).collect()}
    assert langid.identify(table, network).count() == len(rows) and got[1].kept == "extra"
    assert {k for k, r in got.items() if r.lang_pred == "und"} == {None, 2, 3, 4, 22} and got[2].score == 0
    assert got[20].lang_pred == "yy" == got[21].lang_pred and got[20].score == got[24].score > 0.9
    assert langid.identify(table.limit(0), network).count() == 0


def test_windows_hold_every_run_of_bytes():
    text = "".join(chr(33 + i * 7 % 90) for i in range(3_000)).lower()
    windows = langid.windows_of(text)
    runs = {bytes(w[i:i + langid.REACH + 1]) for w in windows for i in range(langid.SPAN)}
    assert all(text[i:i + langid.REACH + 1].encode() in runs for i in range(len(text) - langid.REACH))
    assert langid.windows_of("").shape == (1, langid.WINDOW)


def test_nothing_to_learn(spark):
    assert langid.learn(labelled(spark).limit(0)) is None
    assert langid.learn(labelled(spark).where("doc_id in (100, 101, 102)")) is None
    got = langid.identify(docs(spark, AWKWARD), None, carry=["doc_id"]).collect()
    assert {(r.lang_pred, r.score) for r in got} == {("und", 0.0)}
    one = langid.learn(labelled(spark).where("lang = 'xx'"))
    assert {r.lang_pred for r in langid.identify(labelled(spark).where("doc_id < 4"), one).collect()} == {"xx"}
