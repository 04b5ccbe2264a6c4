"""SimHash near duplicates against brute force, and their defined edge cases."""

import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tripchain.llm import simhash
from tripchain.llm.common import Scratch


def fingerprint_by_hand(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for space in "\t\n\v\f\r":
        words = words.replace(space, " ")
    words = [w for w in words.split(" ") if w]
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components_by_hand(ids, fps):
    fps = np.array(fps, np.uint64)
    label = np.arange(len(fps))
    near = np.bitwise_count(fps[:, None] ^ fps[None]) <= 2
    while True:
        least = np.where(near, label[None], len(fps)).min(1)
        if (least == label).all():
            break
        label = least
    known = {}
    for i, top in zip(ids, label):
        known[top] = min((x for x in (known.get(top), i) if x is not None), default=None)
    return [known[top] for top in label]


def near_fingerprints(rnd, n):
    """Random ones, chains and balls round some of them, in dense and in empty regions."""
    fps = [rnd.getrandbits(64) for _ in range(n)] + [rnd.getrandbits(20) for _ in range(n)] + [0, (1 << 64) - 1]
    for start in fps[: n // 4] + fps[n : n + n // 4] + fps[-2:]:
        for _ in range(6):
            start ^= (1 << rnd.randrange(64)) | (1 << rnd.randrange(64))
            fps.append(start)
    return list(dict.fromkeys(fps))


def test_tree_finds_all_that_is_near():
    rnd = random.Random(4)
    for n in (1, 2, 9, 400):
        fps = np.array(sorted(near_fingerprints(rnd, n)[:n]), np.uint64)
        tree = simhash.GrayTree(np.full(len(fps), ~np.uint64(0)), fps)
        asked = np.concatenate([fps, np.array([rnd.getrandbits(64) for _ in range(20)], np.uint64)])
        after = np.array([rnd.randrange(-1, len(fps)) for _ in asked])
        at, leaf = tree.near(asked, after)
        want = np.nonzero((np.bitwise_count(asked[:, None] ^ fps[None]) <= 2) & (np.arange(len(fps))[None] > after[:, None]))
        assert sorted(zip(at, leaf)) == sorted(zip(*want))


@pytest.mark.parametrize("block, turn", [(simhash.BLOCK, simhash.TURN), (simhash.BLOCK, 50), (64, 32)])
def test_links_join_up_what_is_near(spark, monkeypatch, block, turn):
    monkeypatch.setattr(simhash, "BLOCK", block)
    monkeypatch.setattr(simhash, "TURN", turn)
    monkeypatch.setattr(simhash, "SHARE", 4000)
    monkeypatch.setattr(simhash, "CHUNK", block // 3)
    monkeypatch.setattr(simhash, "WALK", 100)
    fps = near_fingerprints(random.Random(block), 300)
    signed = np.array(fps, np.uint64).view(np.int64).tolist()
    found = simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long"), Scratch(spark)).collect()
    assert len(found) < len(fps) or turn != simhash.TURN
    place = {f: i for i, f in enumerate(signed)}
    top = simhash.joined_up(np.arange(len(fps)), *(np.array([place[r[c]] for r in found]) for c in "ab"))
    assert top.tolist() == components_by_hand(range(len(fps)), fps)


def test_gray_rank(spark):
    codes = [0, 1, 3, 2, 6, 7, 5, 4, 1 << 63, (1 << 63) | 1]
    df = spark.createDataFrame([(int(np.uint64(c).astype(np.int64)),) for c in codes], "fp long")
    ranks = [r[0] + (1 << 63) for r in df.select(simhash.gray_rank(F.col("fp"))).collect()]
    assert ranks[:8] == list(range(8)) and ranks[8:] == [(1 << 64) - 1, (1 << 64) - 2]


def test_documents(spark):
    rnd = random.Random(8)
    word = lambda: "".join(rnd.choice("abcdeéÉA") for _ in range(rnd.randrange(1, 6)))
    base = [word() for _ in range(400)]
    texts = [None, "", " \n\t", "one", "ONE", "one two", "one\ntwo", "one two three", " x ", "a b a b a b a b", " ".join(base)]
    for i in range(12):
        near = list(base)
        near[rnd.randrange(400)] = word()
        texts.append("  ".join(near))
    texts += [" ".join(word() for _ in range(rnd.randrange(1, 60))) for _ in range(40)] + [" ".join(word() for _ in range(90_000))]
    rows = [(i, t) for i, t in enumerate(texts)] + [(3, "one"), (None, "one"), (None, "alone in this"), (-5, " ".join(base))] * 2
    rnd.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"fp": F.lit("clash"), "part": F.lit(1), "known": F.lit(2)})
    fps = [fingerprint_by_hand(t) for _, t in rows]
    want = [(i, f"{fp:016x}", c) for (i, _), fp, c in zip(rows, fps, components_by_hand([i for i, _ in rows], fps))]
    key = lambda r: (str(r[0]), r[1], str(r[2]))
    assert sorted((tuple(r) for r in simhash.report(df).collect()), key=key) == sorted(want, key=key)


def test_empty_table(spark):
    assert simhash.report(spark.createDataFrame([], "doc_id long, text string")).count() == 0
