"""The pipeline's stages: what each one decides, odd rows, and the whole run against plain versions stage by stage."""

import numpy as np
import public_tokenizers
import pytest
from llm_plain import FOLDER, SCHEMA, multiset, odd_documents, words
from pyspark.sql import functions as F
from test_duplicates import plain_repeats, plain_similar
from test_tokens import check_packing

import corpus_pipeline
from quire.llm import langid, toxicity
from quire.llm.common import filter_texts
from quire.llm.pieces import load


def rows_of(df):
    return multiset(df.select(*corpus_pipeline.COLUMNS).collect())


def plain(name, docs):
    """What a stage must give for these rows, without its distributed parts."""
    if name == "near_duplicates":
        gone = {d for d, _, _, kept in plain_similar(docs) if not kept}
        out, seen = [], set()
        for r in docs:
            if r[0] is None or (r[0] not in gone and r[0] not in seen):
                out.append(r)
                seen.add(r[0])
        return out
    if name == "substrings":
        found = {}
        for doc, n, removed, kept in plain_repeats(docs):
            found.setdefault((doc, n), []).append((removed, kept))
        out = []
        for r in docs:
            removed, kept = found[r[0], len(words(r[1]))][0]
            if removed == 0:
                out.append(r)
            elif removed < len(words(r[1])):
                out.append((r[0], kept, r[2], r[3], len(kept)))
        return out
    raise KeyError(name)


def test_stages_and_columns():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "language", "near_duplicates", "substrings", "packing"]
    assert corpus_pipeline.ORACLE_SQL is None


def distinct_documents():
    """The odd documents with one row per id."""
    seen, out = set(), []
    for r in odd_documents():
        if r[0] not in seen or r[0] is None:
            out.append(r)
            seen.add(r[0])
    return out


@pytest.mark.parametrize("name", ["near_duplicates", "substrings"])
def test_text_stages(spark, name):
    docs = distinct_documents()
    df = spark.createDataFrame(docs, SCHEMA)
    found = dict(corpus_pipeline.STAGES)[name](spark, df, FOLDER)
    assert found.columns == corpus_pipeline.COLUMNS
    assert rows_of(found) == multiset(plain(name, docs))


def test_texts_that_share_an_id(spark):
    """Only near copies and repeats of the same id and text go, not other texts under their ids."""
    text = lambda name: " ".join(f"{name}{i}" for i in range(60))
    row = lambda d, t: (d, t, "en", "web", len(t))
    stay = [row(3, text("c")), row(5, text("a")), *[row(7, text(f"{k}x")) for k in range(3)], row(9, text("e")), row(None, text("c"))]
    go = [row(5, text("c") + " more"), row(7, text("c")), row(9, text("e")), row(9, text("e") + " more"), row(11, text("e"))]
    df = spark.createDataFrame(stay + go, SCHEMA)
    found = [(r.doc_id, r.text.removesuffix(" more")) for r in corpus_pipeline.near_duplicate_stage(spark, df, FOLDER).collect()]
    assert multiset(found) == multiset((r[0], r[1]) for r in stay)


def test_filter_stages(spark):
    docs = distinct_documents()
    df = spark.createDataFrame(docs, SCHEMA)
    model = langid.fit(df)
    verdict = langid.label(model, [t for _, t, *_ in docs])
    kept = [r for r, p, s in zip(docs, verdict["lang_pred"], verdict["score"]) if p != "und" and s >= corpus_pipeline.LANGUAGE_SHARE]
    assert rows_of(corpus_pipeline.language_stage(spark, df, FOLDER)) == multiset(kept)
    real = spark.read.parquet(f"{FOLDER}/documents.parquet")
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    classifier = toxicity.fit(real, labels)
    kept = [tuple(r) for r in real.collect() if classifier.score(r.text) < corpus_pipeline.TOXIC]
    found = corpus_pipeline.toxicity_stage(spark, real, FOLDER)
    assert found.columns == corpus_pipeline.COLUMNS and rows_of(found) == multiset(kept)
    clean = labels.where("toxic = 0").join(found, "doc_id", "left_anti").count()
    assert clean == 0  # labelled clean documents stay


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_odd_rows(spark, odd, empty, name):
    """Nulls, repeats, clashing columns and empty tables go through every stage."""
    stage = dict(corpus_pipeline.STAGES)[name]
    clash = odd.drop("toxic") if name == "toxicity" else odd
    found = stage(spark, clash, FOLDER)
    assert found.count() > 0
    if name != "packing":
        assert found.columns == corpus_pipeline.COLUMNS
        ids = [r.doc_id for r in found.collect()]
        assert set(ids) <= {d for d, *_ in odd_documents()} and len(ids) <= len(odd_documents())
        assert ids.count(None) == (1 if name == "language" else 2)  # the null text has no letter
    assert stage(spark, empty, FOLDER).count() == 0


def test_run(spark):
    """The last two text stages and the packing of a whole run agree with plain versions of each on its own input."""
    docs, given = spark.read.parquet(f"{FOLDER}/documents.parquet").select(*corpus_pipeline.COLUMNS), None
    for name, stage in corpus_pipeline.STAGES[:-1]:
        given = [tuple(r) for r in docs.collect()]
        docs = stage(spark, docs, FOLDER).cache()
        if name in ("near_duplicates", "substrings"):
            assert rows_of(docs) == multiset(plain(name, given))
    library = load(public_tokenizers.path("byte_bpe_50k.json"))
    ids = [np.array([*library.encode(r.text or "", add_special_tokens=False).ids, 2], "<u4") for r in docs.collect()]
    pieces = corpus_pipeline.run(spark, FOLDER).collect()
    used = check_packing(pieces, ids, 1024)
    assert used <= -(-sum(map(len, ids)) // 1024) * 1.05 + 1
    assert {r.doc_id for r in pieces} == {r.doc_id for r in docs.select("doc_id").collect()}
    assert docs.agg(F.countDistinct("doc_id")).first()[0] == docs.count()


def test_filters_hold_few_texts_at_a_time(spark):
    """A batch of Arrow has up to 10,000 rows; a judge never sees them all as strings at once, and no row is lost."""

    def judge(texts):
        if len(texts) > 1024:
            raise ValueError(f"{len(texts)} texts at a time")
        return [t is None or not t.endswith("7") for t in texts]

    docs = spark.range(0, 3000, 1, 1).select("id", F.when(F.col("id") % 5 > 0, F.concat(F.lit("text "), "id")).alias("text"))
    kept = filter_texts(docs, judge).collect()
    assert sorted(r.id for r in kept) == [k for k in range(3000) if k % 5 == 0 or k % 10 != 7]


def test_tasks_leave_little_behind(monkeypatch):
    """Few texts leave the last pass of the substrings stage at a time, each text comes once, and a task's end gives memory back."""
    import pyarrow as pa

    from quire.llm import common, substrings

    given = []
    monkeypatch.setattr(common, "give_back", lambda: given.append(True))
    n = 2500
    columns = {"number": pa.array(range(n)), "body": pa.array([f" text  {k}" for k in range(n)]), "copy": pa.array([False] * n),
               "repeats": pa.array([None] * n, pa.list_(pa.int64())), "carried_1": pa.array(["en"] * n)}
    out = list(substrings._kept_rows(13, [1, 4])(iter([pa.RecordBatch.from_pydict(columns)])))
    assert max(b.num_rows for b in out) <= 1024 and given == [True]
    assert pa.Table.from_batches(out).to_pydict() == {"doc_id": [*range(n)], "n_words": [2] * n, "n_removed": [0] * n, "kept": [f"text {k}" for k in range(n)],
                                                      "carried_0": [f" text  {k}" for k in range(n)], "carried_1": ["en"] * n}
