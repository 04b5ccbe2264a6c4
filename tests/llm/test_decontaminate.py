"""The index against plain sorting and counting, and benchmarks of several blocks."""

import random
import tracemalloc
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest

from tripchain.llm import decontaminate

DOCS = "doc_id long, text string, n_chars long"


@pytest.mark.parametrize("n", [0, 1, 2, 63, 64, 65, 300])
def test_index_against_plain_lists(n):
    rng = np.random.default_rng(n)
    for symbols in (rng.integers(1, 5, n), np.ones(n, np.int64), np.tile([1, 2, 3], n)[:n]):
        symbols = np.append(symbols, 0)
        size, text = len(symbols), symbols.tolist()
        order = sorted(range(size), key=lambda i: text[i:])
        assert decontaminate.suffix_order(symbols).tolist() == order
        wavelet = decontaminate.Wavelet(symbols, 3)
        places = np.arange(size + 1)
        for c in range(5):
            assert wavelet.rank(np.full(size + 1, c), places).tolist() == [text[:i].count(c) for i in places]
        index = decontaminate.FmIndex(symbols, 5)
        assert index.locate(np.arange(size)).tolist() == order
        for pattern in ([1], [1, 2], [2, 1, 1], [4, 4]):
            low, high = index.search(np.array([[-1] * (3 - len(pattern)) + pattern]))
            found = sorted(index.locate(np.arange(low[0], high[0])).tolist())
            assert found == [i for i in range(size) if text[i : i + len(pattern)] == pattern]


def test_a_benchmark_of_several_blocks_gives_what_one_block_gives(spark, monkeypatch):
    rnd = random.Random(6)
    word = lambda: rnd.choice("abcdefgh") + rnd.choice("xyzé")
    items = [" ".join(word() for _ in range(rnd.randrange(1, 30))) for _ in range(40)]
    texts = [" ".join([word(), *rnd.choice(items).split()[: rnd.randrange(5, 30)], "own", *rnd.choice(items).split()]) for _ in range(60)] + [None, "", "own"]
    docs = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], DOCS)
    benchmark = spark.createDataFrame([*((i % 38, t) for i, t in enumerate(items)), (None, "own"), (90, None)], "item_id long, text string")

    def both():
        return [sorted(map(tuple, df.collect())) for df in (decontaminate.report(docs, benchmark), decontaminate.clean(docs, benchmark).fillna("-"))]
    whole, sent = both(), []
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 2 * sum(len(t.encode()) for t in items) // 3)
    searcher = decontaminate._searcher
    monkeypatch.setattr(decontaminate, "_searcher", lambda block, n: (sent.append(len(block.value)), searcher(block, n))[1])
    assert both() == whole
    assert len(sent) == 2 * 4 or len(sent) == 2 * 3
    assert sum(sent) == 2 * 41 and max(sent) < 41
    assert any(r[2] for r in whole[0])


def test_a_shard_holds_little_memory():
    """A task works on the texts of a batch shard by shard; what one index and its words hold is bounded, whatever the batch."""
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(5000)]
    texts = [" ".join(words[i] for i in rng.integers(0, 5000, 1500)) for _ in range(1000)]  # 9 MB
    kind = pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))
    batch = pa.RecordBatch.from_pydict({"_text": texts, "spans": pa.nulls(1000, kind), "items": pa.nulls(1000, pa.list_(pa.string())), "n_words": pa.array([0] * 1000)})
    sent = SimpleNamespace(value=[("a", texts[7].encode()[:200])])
    tracemalloc.start()
    found = list(decontaminate._searcher(sent, 10)(iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sum(part.num_rows for part in found) == 1000 and sum(map(bool, (x for part in found for x in part.column("items").to_pylist()))) == 1
    assert peak < 120 << 20, peak
