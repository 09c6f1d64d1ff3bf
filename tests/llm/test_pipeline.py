from __future__ import annotations

import hashlib
from collections import Counter

import duckdb
import pytest
import sentencepiece
from pyspark.sql import functions as F

import corpus_pipeline
from lorekeep.llm import oracles, queries
from tests.llm.test_models import brute_groups
from tests.llm.test_text_operators import MODEL, bag, brute_lines


def plain(frame):
    return [(r["doc_id"], r["text"]) for r in frame.select("doc_id", "text").collect()]


def test_stages_against_brute_force(spark, sf_dir):
    docs = queries.table(spark, sf_dir, "documents")
    labels = {r["doc_id"]: r["quality"] for r in queries.table(spark, sf_dir, "labels").collect()}
    kept = corpus_pipeline.keep_good(spark, docs, sf_dir).cache()
    assert kept.columns == docs.columns and not bag(kept, *docs.columns) - bag(docs, *docs.columns)
    assert not {r["doc_id"] for r in docs.select("doc_id").collect() if labels.get(r["doc_id"]) == 1} - {r["doc_id"] for r in kept.select("doc_id").collect()}

    lines = corpus_pipeline.drop_repeated_lines(spark, kept, sf_dir).cache()
    assert lines.columns == docs.columns
    sha = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
    assert Counter((d, sha(t)) for d, t in plain(lines)) == Counter((d, s) for d, _, _, s in brute_lines(plain(kept)))

    single = corpus_pipeline.keep_one_of_similar(spark, lines, sf_dir).cache()
    assert single.columns == docs.columns
    assert {d for d, _ in plain(single)} == {c for _, _, c in brute_groups(plain(lines))}

    mixed = corpus_pipeline.mix_sources(spark, single, sf_dir).cache()
    assert mixed.columns == docs.columns and max(Counter(plain(mixed)).values()) <= 3

    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    encoded = corpus_pipeline.encode_pieces(spark, mixed, sf_dir)
    assert bag(encoded, "doc_id", "n_tokens") == Counter((d, len(library.encode(t or "", add_eos=True))) for d, t in plain(mixed))


def test_bad_documents_go(spark):
    folder = "/root/testdata/sf0.01"  # the smallest with enough labelled bad rows for a fit
    docs = queries.table(spark, folder, "documents")
    labels = {r["doc_id"]: r["quality"] for r in queries.table(spark, folder, "labels").collect()}
    kept = {r["doc_id"] for r in corpus_pipeline.keep_good(spark, docs, folder).select("doc_id").collect()}
    bad, good = ({r["doc_id"] for r in docs.select("doc_id").collect() if labels.get(r["doc_id"]) == q} for q in (0, 1))
    assert len(bad - kept) >= 0.95 * len(bad) > 0 and len(good & kept) >= 0.99 * len(good)


def test_run(spark, sf_dir):
    got = corpus_pipeline.run(spark, sf_dir)
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and got.count() > 50


def test_stages_take_odd_rows(spark, docs, empty, sf_dir):
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf_dir).count() > 0, name
        assert stage(spark, empty, sf_dir).count() == 0, name


def test_rows_without_id_are_near_copies_too(spark, docs):
    words = [f"w{i}" for i in range(40)]
    rows = [(None, " ".join(words)), (None, " ".join(words[:-1])), (3, " ".join(x + "y" for x in words)), (None, " ".join(x + "y" for x in words[1:])), (3, "other text of five words"), (None, ""), (None, "")]
    got = corpus_pipeline.keep_one_of_similar(spark, spark.createDataFrame(rows, "doc_id bigint, text string"), "")
    assert Counter(i for i, _ in plain(got)) == Counter({None: 2, 3: 2})


@pytest.mark.parametrize("name", sorted(oracles.oracle_sql()))
def test_sql(spark, sf_dir, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{sf_dir}/documents.parquet')")
    cursor = con.execute(oracles.oracle_sql()[name])
    columns = [c[0] for c in cursor.description]
    tidy = lambda rows: Counter(tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in rows)
    got = queries.queries()[name](spark, sf_dir).select(*[F.col(c) for c in columns])
    assert tidy(map(tuple, got.collect())) == tidy(cursor.fetchall())
