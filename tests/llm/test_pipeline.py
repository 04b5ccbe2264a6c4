"""The pipeline against a plain chain of its stages, with odd rows and clashing columns."""

import random

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from test_operators import components_by_hand, windows_removed
from tokenizers import Tokenizer

import corpus_pipeline
from tripchain.llm import decontaminate, quality

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
CLASH = {"_score": 5, "_tk": "mine", "_kept": 1.5, "_id": b"x", "ids": "own", "decoded": 2, "sid": 3}


def clashing(df):
    return df.withColumns({name: F.lit(value) for name, value in CLASH.items()})


def rows_of_texts():
    rnd = random.Random(6)
    word = lambda: "".join(rnd.choice("abcdeé") for _ in range(rnd.randrange(2, 7)))
    base, passage = [word() for _ in range(150)], [word() for _ in range(50)]
    texts = [None, "", " \n", "one", " ".join(base), " ".join(base), " ".join(base[:-2] + ["x", "y"])]
    texts += [" ".join([word() for _ in range(30)] + passage + [word() for _ in range(30)]) for _ in range(4)]
    texts += [" ".join(["zz", *ITEM.split(), "yy"]) + " " + " ".join(word() for _ in range(20)), " ".join(word() for _ in range(5000))]
    return list(enumerate(texts)) + [(3, "one"), (None, "no id at all here"), (40, None)]


ITEM = "q1 q2 q3 q4 q5 q6 q7 q8 q9 q10 q11 q12"


def by_hand(rows, accepted):
    """Rows (doc_id, text) that stay, and of each how many words its repeated passages have."""
    rows = [r for r in rows if r in accepted]
    of = components_by_hand([(1e9 if i is None else i, t) for i, t in rows])
    first, kept = {}, []
    for (i, t), (_, n, c) in sorted(zip(rows, of), key=lambda x: (x[0][0] is None, x[0][0] or 0, x[0][1] or "")):
        if not n or c not in first:
            first[c] = kept.append((i, t))
    cut = windows_removed([t for _, t in kept], 35)
    return kept, [gone for _, gone, _ in cut]


@pytest.mark.parametrize("clash", [False, True])
def test_pipeline_equals_a_plain_chain(spark, tmp_path, clash):
    rows = rows_of_texts()
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], DOCS)
    docs = clashing(docs) if clash else docs
    docs.repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    # Every text is good but those with the one word "one".
    labels = spark.createDataFrame([(i, 0 if t == "one" else 1, 0) for i, t in rows], "doc_id long, quality int, toxic int")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, ITEM), (2, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    model = quality.fit(docs, labels)
    scores = dict(zip([t for _, t in rows], model.scores([(t or "").encode() for _, t in rows]).tolist()))
    accepted = [r for r in rows if scores[r[1]] >= 0.3]
    kept, cut = by_hand(rows, accepted)
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert got.columns == ["doc_id", "lang", "source", "n_tokens", "ids", "exact"]
    found = got.collect()
    assert all(r["exact"] and r["n_tokens"] == len(r["ids"]) and r["lang"] == "en" for r in found)
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in found) == sorted((i is None, i or 0) for i, _ in kept)
    library = Tokenizer.from_file(public_tokenizers.path(corpus_pipeline.VOCABULARY))
    texts = {r["doc_id"]: library.decode(r["ids"], skip_special_tokens=False) for r in found}
    for (i, t), gone in zip(kept, cut):
        if gone:
            assert len(texts[i].split()) == len(t.split()) - gone
        elif ITEM in (t or ""):
            span = t.encode().find(ITEM.encode())
            assert texts[i] == t[:span] + t[span + len(ITEM):]
        else:
            assert texts[i] == (t or "")


def test_stages_keep_clashing_columns(spark, tmp_path):
    docs = clashing(spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows_of_texts()], DOCS))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, ITEM)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns and out.schema.simpleString() == docs.schema.simpleString(), name
        first = out.select(*CLASH).distinct().collect()
        assert [tuple(r) for r in first] == [(5, "mine", 1.5, bytearray(b"x"), "own", 2, 3)], name


def test_pipeline_of_no_rows(spark, tmp_path):
    for name, schema in (("documents", DOCS), ("labels", "doc_id long, quality int, toxic int"), ("benchmark", "item_id long, text string")):
        spark.createDataFrame([], schema).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
