"""The registered queries against SQL, and against brute force where SQL can't say them."""

import re
import zlib

import numpy as np
import pandas as pd
import pytest
import xxhash

from compare import differences, duck
from meterline.llm import QUERIES, SQL
from meterline.llm.settings import tokenizer_path

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.fixture(scope="module")
def documents(con):
    return con.execute("select * from documents order by doc_id").df()


def result(spark, name, *by):
    return QUERIES[name](spark, SF).toPandas().sort_values(list(by)).reset_index(drop=True)


@pytest.mark.parametrize("name", list(SQL))
def test_same_rows_as_sql(spark, con, name):
    assert differences(QUERIES[name](spark, SF), con, SQL[name]) == []


def test_all_registered():
    import __spark_entry__ as entry

    names = entry.queries()
    assert [n for n in range(1, 14) if not any(q.startswith(f"op{n}_") for q in names)] == []
    assert "pipeline" in names and set(SQL) <= set(entry.oracle_sql())


def brute_fingerprint(text):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))]
    ones = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), seed=42)
        for b in range(64):
            ones[b] += h >> b & 1
    return sum((2 * ones[b] > len(shingles)) << b for b in range(64))


def brute_components(prints, ids, distance=3):
    near = np.bitwise_count(np.array(prints, "u8")[:, None] ^ np.array(prints, "u8")[None]) <= distance
    least = np.array(ids)
    while True:
        new = np.array([least[row].min() for row in near])
        if (new == least).all():
            return least.tolist()
        least = new


def test_simhash(spark, documents):
    got = result(spark, "op3_simhash_dedup", "doc_id")
    prints = [brute_fingerprint(t) for t in documents.text]
    assert got.fingerprint.tolist() == [f"{p:016x}" for p in prints]
    assert got.component_id.tolist() == brute_components(prints, documents.doc_id.tolist())
    assert (got.kept == (got.doc_id == got.component_id)).all()


def test_toxicity_on_held_out(spark):
    sf = "/root/testdata/sf0.01"
    got = QUERIES["op4_toxicity"](spark, sf).toPandas()
    assert got.score.between(0, 1).all() and ((got.score >= 0.5) == (got.predicted == 1)).all()
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in got.doc_id]).all()
    labels = duck(sf).execute("select * from labels").df()
    held = got[got.held_out].merge(labels, on="doc_id")
    assert (held.predicted == held.toxic).mean() > 0.95
    assert held[held.toxic == 0].predicted.mean() < 0.02


def test_packing(spark, documents):
    from tokenizers import Tokenizer

    got = QUERIES["op5_packing"](spark, SF).toPandas()
    coded = Tokenizer.from_file(tokenizer_path()).encode_batch(documents.text.tolist(), add_special_tokens=False)
    ids = {d: np.array(c.ids + [2], "<u4") for d, c in zip(documents.doc_id, coded)}
    for p in got.itertuples():
        assert p.doc_tokens == len(ids[p.doc_id])
        assert p.ids_crc32 == zlib.crc32(ids[p.doc_id][p.start:p.start + p.length].tobytes())
    for d, pieces in got.groupby("doc_id"):
        ends = pieces.sort_values("start")
        assert (ends.start + ends.length).tolist() == [*ends.start.tolist()[1:], len(ids[d])] and ends.start.min() == 0
    assert set(got.doc_id) == set(ids)
    for _, s in got.sort_values("offset").groupby("sequence_id"):
        assert s.offset.tolist() == [0, *s.length.cumsum().tolist()[:-1]]
        assert s.length.sum() == s.capacity.iloc[0] <= 4096 and s.length.sum().bit_count() == 1


def test_mixing(spark, documents):
    got = result(spark, "op10_source_mixing", "doc_id")
    assert got["size"].tolist() == [len(WORD.findall(t or "")) for t in documents.text]
    got["source"] = documents.source
    total, size = got["size"].sum(), got.groupby("source")["size"].sum()
    weight = pd.Series([i % 3 + 1 for i in range(len(size))], size.index).astype(float)
    target, free = pd.Series(0.0, size.index), pd.Series(True, size.index)
    while True:
        target[free] = (total - target[~free].sum()) * weight[free] / weight[free].sum()
        above = free & (target > 3 * size)
        if not above.any():
            break
        target[above], free = 3.0 * size[above], free & ~above
    sums = got.groupby("source").agg(target=("target", "first"), size=("source_size", "first"), taken=("taken", "sum"))
    assert (sums["size"] == size).all() and np.allclose(sums.target, target)
    assert ((sums.taken - target).abs() <= got["size"].groupby(got.source).max() / 2 + 1).all()
    assert (got.taken <= 3 * got["size"]).all()
    again = result(spark, "op10_source_mixing", "doc_id")
    assert again.taken.tolist() == got.taken.tolist()


def test_extraction(spark, con):
    """The generated pages have their main text in one article element."""
    from html import unescape

    got = result(spark, "op2_html_extraction", "page_id")
    pages = con.execute("select * from pages order by page_id").df()
    for text, html in zip(got.text, pages.html):
        inside = re.search(r"<article>(.*?)(</article>|$)", html, re.S)
        blocks = re.split(r"</?(?:p|h1)>", inside[1] if inside else "")
        plain = [re.sub(r"\s+", " ", unescape(re.sub(r"</?b>|<br>|<[^>]*$", " ", b))).strip() for b in blocks]
        assert text == "\n\n".join(b for b in plain if b)
    assert got.n_chars.tolist() == [len(t) for t in got.text]


def test_pipeline(spark):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "simhash_dedup", "mixing", "packing"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names, counts = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF).cache()
        assert docs.columns == names, name
        counts.append(docs.count())
        if name == "simhash_dedup":
            left = docs.toPandas()
            prints = [brute_fingerprint(t) for t in left.text]
            assert brute_components(prints, left.doc_id.tolist()) == left.doc_id.tolist()
    assert counts[0] >= counts[1] > counts[2] >= counts[3] > 0
    packed = QUERIES["pipeline"](spark, SF).toPandas()
    assert packed.groupby("sequence_id").length.sum().map(lambda n: n.bit_count() == 1).all()
    assert set(packed.doc_id) == {r.doc_id for r in docs.select("doc_id").collect()}
