"""The registered queries: SQL, brute force where there is none, and the pipeline's stages."""

from __future__ import annotations

import zlib

import duckdb
import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from graphspark.llm.queries import oracle_sql, queries
from test_near_duplicates import brute as near_brute
from test_decontamination import brute as leak_brute
from test_language import plain_classifier
from test_pii import brute as pii_brute
from test_pii import plain_method
from test_tokens import check_packing

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in ("documents", "benchmark", "labels", "conversations"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{DIR}/{name}.parquet')")
    return con


@pytest.fixture(scope="module")
def documents():
    return pq.read_table(f"{DIR}/documents.parquet").to_pandas()


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    got, want = queries()[name](spark, DIR).toPandas(), duck.execute(oracle_sql()[name]).fetchdf()
    columns = sorted(want.columns)
    assert columns == sorted(got.columns)
    values = lambda x: sorted(map(repr, x[columns].astype(object).values.tolist()))
    assert values(got) == values(want)


def test_base_entities(spark, documents):
    import hashlib

    rows = {x.doc_id: x for x in queries()["op1_personal_data"](spark, DIR).collect()}
    for doc, text in zip(documents.doc_id, documents.text):
        line = ",".join(f"{k}:{a}:{b}" for k, a, b in pii_brute(text))
        assert rows[doc].base_sha256 == hashlib.sha256(line.encode()).hexdigest() and rows[doc].spans.startswith(line)


def test_languages(spark, documents):
    got = queries()["op4_language"](spark, DIR).toPandas().merge(documents, on="doc_id")
    assert (got.held_out == [zlib.crc32(str(x).encode()) % 3 == 1 for x in got.doc_id]).all()
    held = got[got.held_out]
    assert (held.lang == held.lang_pred).mean() > 0.97


def test_token_counts_and_packing(spark, documents):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = {x.doc_id: x.n_tokens for x in queries()["op9_token_counts"](spark, DIR).collect()}
    assert rows == {d: len(library.encode(t, add_special_tokens=False).ids) for d, t in zip(documents.doc_id, documents.text)}
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ids = {d: np.array([*library.encode(t, add_special_tokens=False).ids, 2], "<u4") for d, t in zip(documents.doc_id, documents.text)}
    check_packing(queries()["op10_packing"](spark, DIR).collect(), ids, 4096)


def test_pipeline_stage_by_stage(spark, documents, tmp_path):
    """Each stage's decisions are those of brute force on its own input."""
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    tables = [docs.toPandas()]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, DIR).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        tables.append(docs.toPandas())
    source, spoken, unique, clean, private, packed = tables
    for x in tables[1:5]:
        assert list(x.columns) == list(source.columns)
    known = source[source.doc_id.notna() & source.lang.notna() & source.text.notna()]
    predict = plain_classifier([(d, a, t) for d, a, t in zip(known.doc_id, known.lang, known.text) if zlib.crc32(str(d).encode()) % 3 != 1])
    judged = {d: predict(t) for d, t in zip(source.doc_id, source.text)}
    clear = {d for d, (lang, _, margin, _) in judged.items() if margin >= 1e-4 or lang == "und"}
    assert len(clear) > 0.95 * len(judged)
    assert set(spoken.doc_id) & clear == {d for d in clear if not judged[d][3]}
    components = near_brute(list(zip(spoken.doc_id, spoken.text)), corpus_pipeline.NEAR_PERCENT)
    assert set(unique.doc_id) == {k for k, (_, c) in components.items() if c == k}
    items = pq.read_table(f"{DIR}/benchmark.parquet").to_pandas()
    items = list(zip(items.item_id, items.text))
    assert set(clean.doc_id) == {d for d, t in zip(unique.doc_id, unique.text) if not leak_brute(t, items)[1]}
    kept = dict(zip(clean.doc_id, clean.text))
    assert set(private.doc_id) == set(kept)
    added = dict(zip(kept, plain_method([*kept.values()])))
    for doc, text, n in zip(private.doc_id, private.text, private.n_chars):
        cut, last = [], 0
        for a, b, kind in sorted((a, b, k) for k, a, b in [*pii_brute(kept[doc]), *added[doc]]):
            if max(a, last) < b:
                cut += [kept[doc][last : max(a, last)], f"<{kind}>"]
                last = b
        assert text == "".join(cut) + kept[doc][last:] and n == len(text)
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ids = {d: np.array([*library.encode(t, add_special_tokens=False).ids, 2], "<u4") for d, t in zip(private.doc_id, private.text)}
    check_packing([x for x in packed.itertuples()], ids, 4096)


def test_pipeline_on_odd_rows(spark, tmp_path, odd):
    rows = [(k, x, "en" if k % 2 else None, "s", len(x or "")) for k, x in enumerate(odd)] * 2 + [(None, "null id text", "en", None, 3)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").selectExpr("*", "1 AS gone", "2 AS pii_spans").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    found = corpus_pipeline.run(spark, str(tmp_path)).toPandas()
    assert found.doc_id.dropna().is_unique and found.doc_id.isna().sum() == 1
    # a leaked text goes, with or without an id
    leak = "null id text"
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(str(tmp_path / "leak" / "benchmark.parquet"))
    spark.read.parquet(str(tmp_path / "documents.parquet")).write.parquet(str(tmp_path / "leak" / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "leak")).where("doc_id IS NULL").count() == 0
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "none" / "documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "none" / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).collect() == []




def test_pipeline_judges_texts_of_one_id_each(spark, tmp_path, make_docs, prose):
    """Id 5 has a copy of id 3, a text of its own twice and a leaked passage; id 7 repeats 5's own."""
    copied, own, leaked, other = (" ".join(prose(60, 600 + k, 4000)) for k in range(4))
    spark.createDataFrame([(1, leaked)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = make_docs([(3, copied), (5, copied), (5, own), (5, own), (5, leaked), (7, own), (8, other), (None, other)], clash=True)
    unique = corpus_pipeline.near_duplicate(spark, docs, str(tmp_path))
    assert unique.columns == docs.columns
    found = sorted(((x.doc_id, x.text) for x in unique.collect()), key=str)
    assert found == sorted([(3, copied), (5, own), (5, leaked), (8, other), (None, other)], key=str)
    clean = corpus_pipeline.decontamination(spark, unique, str(tmp_path)).collect()
    assert sorted(((x.doc_id, x.text) for x in clean), key=str) == sorted([(3, copied), (5, own), (8, other), (None, other)], key=str)
