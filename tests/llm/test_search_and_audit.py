"""Filter audit, ranked search and nearest neighbours against brute force, with odd rows and columns."""

from __future__ import annotations

import itertools
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from logsieve.llm import filter_audit, lexical_search, pstable, queries
from logsieve.llm.runtime import Scratch


@pytest.fixture(scope="module")
def scratch(spark):
    return Scratch(spark, "search-tests")


# --- filter audit ---


def test_ranks_and_intervals_are_those_of_sorted_orders():
    want = ["".join(p) for p in itertools.permutations("ABCD")]
    assert list(filter_audit.orders("ABCD")) == list(enumerate(sorted(want)))
    lost = Counter()
    for mask, step, first, ranks in filter_audit.intervals(4):
        lost.update((mask, step, r) for r in range(first, first + ranks))
    for rank, order in enumerate(want):
        for mask in range(1, 16):
            step = next(i for i, c in enumerate(order, 1) if mask >> "ABCD".index(c) & 1)
            assert [s for s in range(1, 5) if lost[mask, s, rank]] == [step] and lost[mask, step, rank] == 1


def brute_audit(docs, labels):
    words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t)
    good, toxic = ({i for i, *y in labels if i is not None and y[k] == 1} for k in (0, 1))
    rows = []
    for ident, text, part in docs:
        w, t = words(text or ""), text or ""
        fails = {
            "A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t),
            "D": bool(re.search(r"[#$%&*|]", t)),
            "E": ident is not None and any(i is not None and i < ident and (o or "") == t for i, o, _ in docs),
        }
        rows.append((part or "", fails, ident in good, ident in toxic))
    out = {}
    shapley = Counter()
    for part in {r[0] for r in rows}:
        for order in map("".join, itertools.permutations("ABCDE")):
            left = [r for r in rows if r[0] == part]
            for step, c in enumerate(order, 1):
                gone = [r for r in left if r[1][c]]
                left = [r for r in left if not r[1][c]]
                own = [r for r in rows if r[0] == part and r[1][c]]
                shapley[part, c] += len(gone)
                unique = sum(sum(r[1].values()) == 1 for r in own)
                out[part, order, step] = [len(left), len(gone), len(own) - len(gone), unique, sum(r[2] for r in gone), sum(r[3] for r in gone)]
    return {(p, o, s, *v, shapley[p, o[s - 1]]) for (p, o, s), v in out.items()}


def test_audit_against_every_order(spark):
    rnd = random.Random(5)
    texts = [None, "", "few words", "SHOUT " * 120, "a # b", " ".join(f"w{i}" for i in range(120)), "x　y " * 130, "word " * 30000]
    docs = [(rnd.choice([None, *range(60)]), rnd.choice(texts), rnd.choice([None, "", "en", "de"])) for _ in range(200)]
    docs += [(7, "same", "en")] * 3 + [(8, "same", "en"), (8, "same", "de"), (None, "same", "en")]
    labels = [(i, rnd.choice([0, 1, None]), rnd.choice([0, 1, None])) for i in [*range(0, 60, 2), 4, 4, None]]
    df = spark.createDataFrame([(*d, 1, "m") for d in docs], "doc_id long, text string, lang string, n int, mask string")
    y = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    masks = filter_audit.document_masks(df, y)
    got = filter_audit.audit(masks, "ABCDE", ("good", "toxic"))
    assert {tuple(r) for r in got.collect()} == brute_audit(docs, labels)
    assert got.columns[:6] == ["part", "filter_order", "step", "kept", "removed", "redundant"]
    assert filter_audit.audit(filter_audit.document_masks(df.where("1 = 0"), y), "ABCDE", ("good",)).count() == 0
    assert filter_audit.document_masks(df, y.where("1 = 0")).agg(F.sum("good"), F.sum("n")).first() == (0, len(docs))
    with pytest.raises(ValueError):
        filter_audit.audit(masks, "BA", ())


# --- ranked search ---


def brute_search(docs, text, k=10):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    found = [(i, Counter(split(t))) for i, t in docs]
    sizes = [sum(c.values()) for _, c in found]
    n_docs, occurrences = sum(s > 0 for s in sizes), sum(sizes)
    scores = []
    for (ident, c), n in zip(found, sizes, strict=True):
        total = 0
        for term in set(split(text)):
            df = sum(term in d for _, d in found)
            if df and c[term]:
                w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))
                total += w * (1000000000 * c[term] // (1000 * c[term] + 8 * (10 + 90 * n * n_docs // occurrences)))
        if total > 0:
            scores.append((-total, ident is None, ident or 0))
    return [(rank, None if none else ident, -s) for rank, (s, none, ident) in enumerate(sorted(scores)[:k], 1)]


@pytest.mark.parametrize("shard_terms", [1 << 21, 300])
def test_search_against_scoring_every_document(spark, scratch, monkeypatch, shard_terms):
    monkeypatch.setattr(lexical_search, "ITEMS", 5)
    rnd = random.Random(shard_terms)
    words = ["Alpha", "beta", "gamma7", "ÄÖ", "漢字", "the", "of", "x1", "rare", "𐍈"] + [f"w{i}" for i in range(60)]
    weights = [1 / (i + 1) for i in range(len(words))]
    make = lambda n: rnd.choice([" ", "-", "\n"]).join(rnd.choices(words, weights, k=n))
    docs = [(i, make(rnd.randrange(1, 60))) for i in range(400)]
    docs += [(500 + i, "the same text, the rare one") for i in range(15)] + [(3, "rare rare"), (3, "rare rare"), (None, "rare the"), (None, None), (600, ""), (601, "?! --"), (602, "the " * 40000)]
    items = [(i, make(rnd.randrange(1, 9))) for i in range(12)] + [(90, None), (91, ""), (92, "unheardof"), (93, "rare"), (93, "rare"), (None, "rare THE the"), (94, " ".join(words))]
    df = spark.createDataFrame([(*d, "c") for d in docs], "doc_id long, text string, term string")
    queries_ = spark.createDataFrame([(*i, 5) for i in items], "item_id long, text string, rank int")
    lists = scratch.save(lexical_search.index(df, shard_terms=shard_terms), "index")
    got = defaultdict(list)
    for r in lexical_search.search(lists, queries_, scratch).collect():
        got[r.item_id].append((r.rank, r.doc_id, r.score))
    want = defaultdict(list)
    for ident, text in items:
        want[ident] += brute_search(docs, text)
    assert {i: sorted(v, key=str) for i, v in got.items()} == {i: sorted(v, key=str) for i, v in want.items() if v}
    assert lexical_search.search(lists, queries_.where("1 = 0"), scratch).count() == 0
    nothing = scratch.save(lexical_search.index(df.where("1 = 0")), "none")
    assert lexical_search.search(nothing, queries_, scratch).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.tuples(st.integers(1, 70000), st.integers(1, 100000)), min_size=1, max_size=20), min_size=1, max_size=6))
def test_blocks_come_back(blocks):
    gaps = np.concatenate([[0, *(g for g, _ in b[1:])] for b in blocks])
    tfs = np.array([t for b in blocks for _, t in b])
    starts = np.cumsum([0, *(len(b) for b in blocks[:-1])])
    block = np.repeat(np.arange(len(blocks)), [len(b) for b in blocks])
    data, shapes, begins = lexical_search.compress(gaps, tfs, block, starts)
    for i, b in enumerate(blocks):
        docs, found = lexical_search.expand(memoryview(data.tobytes()), int(begins[i]), len(b), int(shapes[i]), 5)
        assert docs.tolist() == (5 + np.cumsum(gaps[block == i])).tolist() and found.tolist() == [t for _, t in b]


def test_terms_of_a_long_text_are_those_of_its_slices(monkeypatch):
    text = " ".join(random.Random(2).choices(["ab", "c", "Ünd", "1"], k=5000)).encode()
    whole = [t for some in lexical_search.terms(text) for t in some]
    monkeypatch.setattr(lexical_search, "SLICE", 64)
    assert [t for some in lexical_search.terms(text) for t in some] == whole and len(whole) == 5000


def test_lists_are_skipped_without_being_expanded(spark, scratch):
    """Blocks of the frequent term that cannot change the result stay compressed."""
    docs = spark.createDataFrame([(i, "often " + "rare " * (i in (5, 9000)) + f"u{i}") for i in range(20000)], "doc_id long, text string").coalesce(1)
    rows = {r.term: r for r in lexical_search.index(docs).where("term IN (X'', X'6f6674656e', X'72617265')").collect()}
    lengths = np.array(rows[b""].lengths, np.int64)
    impact = lambda tf, n: 1000 * tf // (tf + n)
    lists = []
    for term, weight in ((b"often", 1), (b"rare", 50)):
        row = type("Row", (), rows[term].asDict() | {"weight": weight})
        lists.append(lexical_search._List(row, lengths, impact))
    found, _ = lexical_search.best(lists, len(lengths), 2)
    assert found.tolist() == [5, 9000] and len(lists[0].expanded) < len(lists[0].firsts) / 20


# --- nearest neighbours ---


def brute_nearest(rows, modulo, k=20):
    good = {(i, tuple(v)) for i, v in rows if i is not None and v and None not in v and all(map(math.isfinite, v)) and any(v)}
    out = Counter()
    for i, v in good:
        if i % modulo == 0:
            near = sorted((-float(np.dot(v, w)), j) for j, w in good if len(w) == len(v) and (j, w) != (i, v))
            out.update((i, rank, j, round(-s, 9)) for rank, (s, j) in enumerate(near[:k], 1))
    return out


def test_nearest_of_a_small_table_is_exact(spark, scratch):
    rnd = random.Random(8)
    rows = [(i, [float(rnd.randrange(-3, 4)) for _ in range(6)]) for i in range(150)]
    rows += [(200 + i, [1.0, 2.0, 0.0, 0.0, 1.0, 1.0]) for i in range(60)] + [(40, [1.0, 2.0, 0.0, 0.0, 1.0, 1.0]), (20, rows[20][1]), (20, rows[20][1])]
    rows += [(None, [1.0] * 6), (301, None), (302, []), (303, [0.0] * 6), (304, [1.0, None]), (305, [float("nan")] * 6), (306, [float("inf")] + [1.0] * 5)]
    rows += [(320, [1.0, 2.0]), (321, [0.5, -1.0]), (340, [3.0]), (322, [1e3, 1e4, 0.0, 0.0, 0.0, 1.0]), (360, [1e-3] * 6)]
    df = spark.createDataFrame([(*r, 0.5, "s") for r in rows], "vec_id long, embedding array<double>, id double, size string")
    got = Counter((r.query_id, r.rank, r.vec_id, round(r.score, 9)) for r in pstable.nearest(df, F.col("id") % 20 == 0, scratch).collect())
    assert got == brute_nearest(rows, 20)
    assert pstable.nearest(df.where("1 = 0"), F.col("id") % 20 == 0, scratch).count() == 0
    assert pstable.nearest(df, F.col("id") < 0, scratch).count() == 0


def test_recall_where_buckets_are_chosen(spark, scratch, tmp_path):
    """Vectors of two norms and a crowd of copies; every score is exact."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(9000, 24)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x[:4500] += 0.3 * rng.normal(size=(90, 24)).astype(np.float32).repeat(50, axis=0)
    x[6000:] *= 3
    x[7000:8000] = x[7000]
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<float>")
    rows.write.parquet(f"{tmp_path}/embeddings.parquet")
    got = queries.op13_pstable(spark, str(tmp_path)).toPandas()
    x = x.astype(np.float64)
    hit = 0
    for q, found in got.groupby("query_id"):
        found, scores = found.sort_values("rank"), x @ x[q]
        assert found["rank"].tolist() == list(range(1, 21)) and q not in set(found["vec_id"])
        assert np.allclose(found["score"], scores[found["vec_id"]], atol=1e-9) and (np.diff(found["score"]) <= 0).all()
        scores[q] = -np.inf
        best = np.lexsort((np.arange(len(x)), -np.round(scores, 9)))[:20]
        hit += len(set(best) & set(found["vec_id"]))
    assert got["query_id"].nunique() == 450 and hit >= 0.9 * 20 * 450


def test_the_share_that_is_visited_is_the_share_asked_for():
    """Buckets within the limit hold that share of neighbours drawn at the cosine, and fewer of all vectors."""
    rng, opt, n = np.random.default_rng(1), pstable.Search(), 1 << 17
    q = rng.normal(size=(1, 48))
    q /= np.linalg.norm(q)
    away = rng.normal(size=(4000, 48))
    away -= (away @ q.T) * q
    near = 0.6 * q + 0.8 * away / np.linalg.norm(away, axis=1, keepdims=True)
    other, _ = pstable.unit(rng.normal(size=(4000, 48)))
    cost = pstable.query_costs(q, n, 0.6, opt)[:, 0]
    limit = pstable.limits(cost, 0.8)
    inside = []
    for x in (near, other):
        flat, _ = pstable.projections(x, np.zeros(len(x)), 48, pstable.hashes(n), opt)
        values = pstable.cells(flat)[:, 0]
        total = sum(cost[0, h][values[:, h]].astype(int) for h in range(values.shape[1]))
        inside.append(np.mean(total <= limit[0]))
        met = set(pstable.regions_met(cost, limit, n)[0].tolist())
        assert set(pstable.region(pstable.code(values[total <= limit[0]][:, : pstable.prefix(n)]), n).tolist()) <= met
    assert 0.75 <= inside[0] <= 0.92 and inside[1] < 0.6 * inside[0]
