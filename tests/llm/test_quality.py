"""The classifier against a plain version: whole decomposition, one document and one neighbour at a time."""

import math
import random
import re
import zlib

import numpy as np
from pyspark.sql import functions as F

from tripchain.llm import quality

DOCS = "doc_id long, text string, score string"
LABELS = "doc_id long, quality int, toxic int"


def counted(text):
    """Log counts by term, from the words and shapes themselves."""
    shapes = ["".join("A" if "A" <= c <= "Z" else "0" if "0" <= c <= "9" else "a" if c.isalpha() else c for c in w) for w in text.split()]
    shapes = [re.sub(r"([Aa0])\1+", r"\1", s) for s in shapes]
    words = re.findall("[0-9a-zé]+", text.lower())
    crc = lambda s: zlib.crc32(s.encode())
    found = {}
    for term in [*shapes, *(a + " " + b for a, b in zip(shapes, shapes[1:]))]:
        found[crc(term) % quality.SHAPES] = found.get(crc(term) % quality.SHAPES, 0) + 1
    again = sum(a == b for a, b in zip(text.split(), text.split()[1:]))
    if again:
        found[crc("again") % quality.SHAPES] = found.get(crc("again") % quality.SHAPES, 0) + again

    def mixed(x):
        for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = ((x ^ (x >> shift)) * by) % 2**64
        return (x ^ (x >> 31)) % quality.WORDS + quality.SHAPES
    for column in [*(mixed(crc(w)) for w in words),
                   *(mixed((crc(a) * 0x100000001 + (crc(b) << 17)) % 2**64) for a, b in zip(words, words[1:]))]:
        found[column] = found.get(column, 0) + 1
    return {c: math.log1p(n) for c, n in found.items()}


def plain_scores(train, texts):
    """Scores of texts by (text, label) pairs."""
    df = {}
    for text, _ in train:
        for c in counted(text):
            df[c] = df.get(c, 0) + 1

    def vector(text):
        v = np.zeros(quality.COLUMNS)
        for c, n in counted(text).items():
            v[c] = n * (math.log((1 + len(train)) / (1 + df.get(c, 0))) + 1)
        for part in (v[: quality.SHAPES], v[quality.SHAPES :]):
            if part.any():
                part *= math.sqrt(0.5) / math.sqrt((part * part).sum())
        return v
    matrix = np.array([vector(t) for t, _ in train])
    right = np.linalg.svd(matrix, full_matrices=False)[2][: quality.LATENT]
    latent = [right @ row for row in matrix]
    out = []
    for text in texts:
        own = right @ vector(text)
        near = sorted(((float(own @ v) / max(np.linalg.norm(own) * np.linalg.norm(v), 1e-18), y) for v, (_, y) in zip(latent, train)), reverse=True)
        bound = near[min(quality.NEIGHBOURS, len(near)) - 1][0]
        votes = [(max(s, 0) ** quality.POWER, y) for s, y in near if s >= bound - 1e-12]
        total = sum(w for w, _ in votes)
        out.append(sum(w * y for w, y in votes) / total if total > 1e-12 else sum(y for _, y in train) / len(train))
    return out


def test_scores_are_those_of_a_plain_vote(spark):
    rnd = random.Random(2)
    words = "The river é runs Slow past 12 mills, and old-stone bridges! where 7 herons wait".split()
    rows = [(i, " ".join(rnd.choice(words) for _ in range(rnd.randrange(1, 40))), "theirs") for i in range(70)]
    rows += [(100, None, "x"), (101, "", "x"), (102, "again again again again", None), (103, "Ω zz", "x"), (5, rows[5][1], "x")]
    docs = spark.createDataFrame(rows, DOCS)
    labels = [(i, i % 3 % 2, 0) for i in range(50)]
    train = [(rows[i][1], y) for i, y, _ in labels if zlib.crc32(str(i).encode()) % 5]
    assert len(train) <= quality.LATENT
    got = quality.classify(docs, spark.createDataFrame(labels + [(60, None, 1)], LABELS)).collect()
    assert len(got) == len(rows)
    for (i, text, _), want in zip(rows, plain_scores(train, [r[1] or "" for r in rows])):
        if i == 103:
            continue  # a letter that the plain version has no shape for
        own = [r for r in got if r["doc_id"] == i]
        assert all(abs(r["score"] - want) < 1e-3 for r in own) and own[0]["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0)


def test_words_count_where_the_layout_is_the_same(spark):
    """Texts alike in marks and capitals; only their words tell the labels apart."""
    rnd = random.Random(4)
    kinds = ["quick brown fox river bridge heron slow mill stone water".split(), "vile slur hate awful nasty scorn spite rage venom curse".split()]
    sentence = lambda words: " ".join(rnd.choice(words) for _ in range(7)).capitalize() + "."
    rows = [(i, " ".join(sentence(kinds[i % 2]) for _ in range(3)), None) for i in range(200)]
    got = quality.classify(spark.createDataFrame(rows, DOCS), spark.createDataFrame([(i, 1 - i % 2, 0) for i in range(200)], LABELS)).collect()
    held = [r for r in got if r["held_out"]]
    assert len(held) > 20 and all((r["score"] > 0.7) == (r["doc_id"] % 2 == 0) for r in held)


def test_directions_are_the_leading_ones():
    rng = np.random.default_rng(1)
    left, right = np.linalg.qr(rng.standard_normal((150, 150)))[0], np.linalg.qr(rng.standard_normal((quality.COLUMNS, 150)))[0]
    size = np.where(np.arange(150) < quality.LATENT, 10.0, 0.5)
    found = quality.Model._directions((left * size @ right.T).astype(np.float32), 7)
    own = right[:, : quality.LATENT]
    assert np.abs(found @ found.T @ own - own).max() < 1e-3


def test_the_sample_is_bounded_for_each_label(spark, monkeypatch):
    monkeypatch.setattr(quality, "PER_LABEL", 5)
    docs = spark.createDataFrame([(i, f"word{i} and more", "") for i in range(100)], DOCS)
    labels = spark.range(100).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 90, 1).otherwise(0).alias("quality"), F.lit(0).alias("toxic"))
    model = quality.fit(docs, labels)
    assert sorted(model.labels) == [0] * 5 + [1] * 5
