"""Exact, line and near dedup against plain Python forms, and their edge cases."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from castwise.llm import exact_dedup, line_dedup, near_dedup

LONG = " ".join(f"w{i}" for i in range(30_000))
BASE = [f"b{i}" for i in range(60)]


def edge_rows():
    near = BASE[:30] + ["changed"] + BASE[31:]
    return [
        (1, " ".join(BASE)),
        (2, " ".join(BASE)),
        (3, " ".join(near)),
        (4, None),
        (5, ""),
        (6, "  \t "),
        (7, "one two"),
        (8, "ONE two"),
        (8, "ONE two"),
        (None, "alone in its words here"),
        (9, LONG),
        (10, LONG + " end"),
        (11, "First line of this text\nsecond line here\nfirst LINE of this text\n\nsecond line here"),
        (12, "second line here\nsomething new"),
    ]


def test_exact_against_grouping(docs, made):
    for table in (docs, made(edge_rows())):
        rows = [(r.doc_id, r.text or "") for r in table.select("doc_id", "text").collect()]
        groups = defaultdict(list)
        for i, t in rows:
            groups[t].append(-(2**63) if i is None else i)
        got = exact_dedup.exact_duplicates(table, with_digest=True).collect()
        assert len(got) == len(rows)
        text = dict(rows)
        for r in got:
            ids = groups[text[r.doc_id]]
            assert (r.keep_id if r.keep_id is not None else -(2**63)) == max(ids)
            assert r.group_size == len(ids)
            assert r.kept == (r.keep_id == r.doc_id)
            assert r.text_sha256 == hashlib.sha256(text[r.doc_id].encode()).hexdigest()
    kept = exact_dedup.drop_exact_duplicates(made(edge_rows()))
    assert kept.columns == docs.columns + ["_id", "_text", "hub", "k"]
    assert {r.doc_id for r in kept.collect()} == {2, 3, 5, 6, 7, 8, None, 9, 10, 11, 12}


def brute_lines(rows, threshold=0.8):
    """Lines that go, by (id, text): every line against all earlier ones."""
    seen, gone = [], defaultdict(set)
    for i, t in sorted({(-(2**63) if i is None else i, t or "") for i, t in rows}):
        for k, line in enumerate(t.split("\n")):
            words = frozenset(line.lower().split())
            if not words:
                continue
            if any(len(words & w) >= threshold * len(words | w) - 1e-9 for w in seen):
                gone[i, t].add(k)
            seen.append(words)
    return gone


def test_lines_against_all_pairs(docs, made):
    for table in (docs.limit(80), made(edge_rows())):
        rows = [(r.doc_id, r.text) for r in table.select("doc_id", "text").collect()]
        gone = brute_lines(rows)
        out = line_dedup.drop_repeated_lines(table).collect()
        assert len(out) == len(rows)
        texts = defaultdict(list)
        for i, t in rows:
            texts[i].append(t)
        for r in out:
            t = texts[r.doc_id][0]
            lost = gone[-(2**63) if r.doc_id is None else r.doc_id, t or ""]
            assert r.n_removed == len(lost)
            if t is None:
                assert r.text is None and r.n_lines == 0
            else:
                assert r.text == "\n".join(x for k, x in enumerate(t.split("\n")) if k not in lost)


def shingle_set(text, size):
    words = (text or "").encode().lower().split()
    return frozenset(tuple(words[k : k + size]) for k in range(max(1, len(words) - size + 1))) if words else frozenset()


@pytest.mark.parametrize("size", [4])
def test_near_against_all_pairs(docs, made, size):
    extra = made(edge_rows()).select("doc_id", "text").withColumn("doc_id", F.col("doc_id") + 1_000_000)
    table = docs.select("doc_id", "text").union(extra)
    rows = [(-(2**63) if r.doc_id is None else r.doc_id, r.text) for r in table.collect()]
    sets = {i: shingle_set(t, size) for i, t in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    lists = defaultdict(list)
    for i in sorted(sets):
        for j, shared in Counter(j for s in sets[i] for j in lists[s]).items():
            if 100 * shared >= 80 * (len(sets[i]) + len(sets[j]) - shared):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
        for s in sets[i]:
            lists[s].append(i)
    got = near_dedup.near_duplicates(table, size=size).collect()
    assert len(got) == len(rows)
    for r in got:
        i = -(2**63) if r.doc_id is None else r.doc_id
        assert r.n_shingles == len(sets[i])
        assert (r.component_id if r.component_id is not None else -(2**63)) == find(i)
        assert r.kept == (r.doc_id == r.component_id)


def test_densified_signatures_agree_as_often_as_sets():
    import numpy as np

    rng = np.random.default_rng(1)
    agree = []
    for _ in range(40):
        pool = np.unique(rng.integers(0, 2**63, 60, dtype=np.uint64))
        a, b = pool[:50], pool[10:]  # 40 of 60 shared
        x, y = near_dedup.signature(np.sort(a)), near_dedup.signature(np.sort(b))
        agree.append(np.mean(x == y))
    # a band of ROWS bins agrees with probability about (2/3) ** ROWS
    assert abs(np.mean(agree) - (2 / 3) ** near_dedup.ROWS) < 0.02


def test_components_of_long_paths(spark):
    path = spark.range(1, 60).selectExpr("id as a", "id + 1 as b").union(spark.createDataFrame([(100, 102), (101, 102)], "a long, b long"))
    got = {r.node: r.root for r in near_dedup.components(path).collect()}
    assert all(got[i] == 1 for i in range(2, 61)) and got[101] == got[102] == 100


def test_empty_tables(made):
    none = made([]).limit(0)
    assert exact_dedup.exact_duplicates(none).count() == 0
    assert line_dedup.drop_repeated_lines(none).count() == 0
    assert near_dedup.near_duplicates(none).count() == 0


def test_near_links_beyond_the_first_stars(made):
    """Bundles of copies that are each similar to the original of their bundle only, never to one another."""
    rng = np.random.default_rng(5)
    rows, near = [], []
    for g in range(40):
        words = [f"g{g}w{k}" for k in range(600)]
        whole = shingle_set(" ".join(words), 5)
        for c in range(60):
            mine = list(words)
            for k in rng.choice(100, 12, replace=False) * 6:
                mine[k] = f"c{g}x{c}x{k}"
            own = shingle_set(" ".join(mine), 5)
            if 100 * len(own & whole) >= 80 * len(own | whole):
                near.append((len(rows), 10_000 + g))
            rows.append((len(rows), " ".join(mine)))
    rows += [(10_000 + g, " ".join(f"g{g}w{k}" for k in range(600))) for g in range(40)]
    assert len(near) > 2000
    table = made(rows).repartition(8)
    for given in ({}, {"rounds": 0}):
        got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(table, **given).collect()}
        assert sum(got[i] != got[j] for i, j in near) == 0
        assert all(got[i] // 60 == got[j] // 60 for i, j in near)


def test_parity_never_exceeds_the_difference():
    rng = np.random.default_rng(1)
    for n in (1, 50, 3000):
        a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        b = np.unique(np.append(a[: max(1, n // 2)], rng.integers(0, 2**63, n // 3).astype(np.uint64)))
        unequal = np.bitwise_count(near_dedup.parity(a) ^ near_dedup.parity(b)).sum()
        assert unequal <= len(np.setxor1d(a, b)) and not (near_dedup.parity(a) ^ near_dedup.parity(a)).any()
