"""The Merkle manifest against a plain one, and its defined edge cases."""

import hashlib
import itertools
import random
import zlib

import pytest

from tripchain.llm import merkle

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row):
    doc_id, text, lang, source, n_chars = row
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))


def tree(nodes):
    """(top, steps of each node): a step is what stands left and right."""
    steps = [[] for _ in nodes]
    holders = [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        runs = [range(i, min(i + 3, len(nodes))) for i in range(0, len(nodes), 3)]
        for run in runs:
            for i in run:
                for h in holders[i]:
                    steps[h].append(("".join(nodes[j] for j in run if j < i), "".join(nodes[j] for j in run if j > i)))
        holders = [list(itertools.chain(*(holders[i] for i in run))) for run in runs]
        nodes = [sha("".join(nodes[i] for i in run)) for run in runs]
    return nodes[0], steps


def by_hand(rows):
    first = lambda v: (v is not None, v)
    rows = sorted(rows, key=lambda r: (first(r[3] and r[3].encode() if r[3] else r[3] if r[3] is None else b""), first(r[0]), leaf(r)))
    sources = [list(group) for _, group in itertools.groupby(rows, key=lambda r: r[3])]
    built = [tree([leaf(r) for r in group]) for group in sources]
    root, outer = tree([top for top, _ in built])
    out = []
    for group, (top, steps), rest in zip(sources, built, outer):
        for row, own in zip(group, steps):
            proof = own + rest
            text = row[1]
            if row[0] is not None and zlib.crc32(str(row[0]).encode()) % 2 == 0 and text is not None:
                text = text.replace("\n", "")
            node = leaf((row[0], text, *row[2:]))
            for left, right in proof:
                node = sha(left + node + right)
            out.append((row[0], leaf(row), top, root, sha("".join(a + b for a, b in proof)), node, node == root))
    return out


def rows_of(sizes, seed=1):
    rnd = random.Random(seed)
    text = lambda: rnd.choice([None, "", "a\nb", "é\n\n", "plain", "x" * rnd.randrange(40)])
    rows = []
    for source, n in sizes.items():
        rows += [(rnd.randrange(500), text(), rnd.choice(["en", None]), source, rnd.choice([None, -3, 7])) for _ in range(n)]
    return rows


@pytest.mark.parametrize("sizes", [
    {"a": 1}, {"a": 4}, {None: 1, "a": 1}, {"": 2, "b": 9, None: 3}, {"a": 82, "é": 10, "z": 1, "": 28, "B": 3, None: 5, **{f"s{i}": 1 + i % 4 for i in range(31)}}], ids=lambda s: "-".join(map(str, itertools.islice(s.values(), 6))))
def test_report_equals_a_plain_tree(spark, sizes):
    rows = rows_of(sizes)
    got = [tuple(r) for r in merkle.report(spark.createDataFrame(rows, DOCS)).collect()]
    key = lambda r: (str(r[0]), r[1:])
    assert sorted(got, key=key) == sorted(by_hand(rows), key=key)


def test_repeated_rows_null_ids_and_clashing_columns(spark):
    rows = rows_of({"a": 7, None: 2}) + [(5, "t\n", "l", "a", 1)] * 4 + [(None, "x", None, "a", None)] * 2 + [(9, "y" * 100_000 + "\n", "l", "b", 1)]
    df = spark.createDataFrame([(*r, 1, b"", 2, "p", 3) for r in rows], DOCS + ", tree int, node binary, size int, part string, pos int")
    key = lambda r: (str(r[0]), r[1:])
    assert sorted((tuple(r) for r in merkle.report(df).collect()), key=key) == sorted(by_hand(rows), key=key)


def test_proofs_show_every_change(spark):
    rows = rows_of({"a": 30, "b": 4})
    proven = merkle.manifest(spark.createDataFrame(rows, DOCS)).collect()
    for r in proven:
        for start, same in ((bytes(r["leaf"]), True), (hashlib.sha256(b"other").digest(), False)):
            node = start
            for step in r["proof"]:
                node = hashlib.sha256((bytes(step["left"]) + node + bytes(step["right"])).hex().encode()).digest()
            assert (node == bytes(r["root"])) is same


def test_empty_table(spark):
    assert merkle.report(spark.createDataFrame([], DOCS)).count() == 0
