"""Top-k search, mixing, packing."""

import math
import time
from collections import defaultdict
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from folioforge.llm import mixing as M
from folioforge.llm import packing as P
from folioforge.llm import topk as K

VECTORS = "vec_id long, embedding array<float>, label int, id long, q string"


def brute_top(rows, asked, k, scale=256.0):
    ok = [(i, [math.floor(float(np.float32(x)) * scale) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, v in {i: v for i, v in sorted(ok) if i in asked}.items():
        best = sorted((-sum(a * b for a, b in zip(v, w, strict=False)), j) for j, w in ok if j != i)[:k]
        out += [(i, n + 1, j, -s) for n, (s, j) in enumerate(best)]
    return sorted(out)


def search(spark, rows, k=5, **options):
    v = spark.createDataFrame([(i, x, 1, 5, "y") for i, x in rows], VECTORS)
    return sorted(tuple(r) for r in K.top_k(v, v.where("vec_id % 50 = 0"), k, **options).collect())


def test_top_k_against_brute_force(spark):
    rng = np.random.default_rng(1)
    rows = [(i, (rng.normal(size=16) * 0.2).tolist()) for i in range(400)]
    rows[7] = rows[8] = (7, rows[50][1])
    rows += [(1000, None), (1001, [1.0, None]), (1050, [float("nan")] * 16), (1100, [float("inf")] * 16), (None, [0.1] * 16), (1150, []), (1200, [0.5, -0.5]), (1250, [0.0] * 16), (1300, rows[3][1])]
    rows += [(2000 + i, rows[50][1]) for i in range(20)]
    asked = {i for i, _ in rows if i is not None and i % 50 == 0}
    assert search(spark, rows, block_rows=64, chunk=3) == brute_top(rows, asked, 5)


def test_top_k_of_few(spark):
    assert search(spark, []) == []
    assert search(spark, [(50, [1.0])]) == []
    assert search(spark, [(50, [1.0]), (3, [2.0])]) == [(50, 1, 3, 131072)]


def test_top_k_of_many_in_time(spark, tmp_path):
    """1.6e9 pairs, which took minutes of every core when each pair was scored in slices."""
    v = np.random.default_rng(2).normal(size=(200_000, 64)).astype(np.float32) / 8
    v[100:140] = v[7]  # ties
    lists = pa.ListArray.from_arrays(np.arange(0, v.size + 1, 64, dtype=np.int32), v.ravel())
    pq.write_table(pa.table({"vec_id": np.arange(len(v)), "embedding": lists}), tmp_path / "v.parquet")
    vectors = spark.read.parquet(str(tmp_path / "v.parquet"))
    began = time.time()
    got = K.top_k(vectors, vectors.where("vec_id % 25 = 0")).toPandas()
    assert time.time() - began < 40
    assert len(got) == 40_000
    q = np.floor(v.astype(np.float64) * 256)
    for i in [0, 100, 125, *range(150, 200_000, 4975)]:
        scores = q @ q[i]
        order = [j for j in np.lexsort((np.arange(len(q)), -scores))[:6] if j != i][:5]
        mine = got[got.query_id == i].sort_values("rank")
        assert (mine.vec_id.tolist(), mine.score.tolist()) == (order, scores[order].tolist())


@pytest.mark.parametrize("size", [1, 6, 3_000, 10**8, 2**53])
def test_kinds_of_sums_agree_with_brute_force(size, monkeypatch):
    """Floats, doubles and slices, over several tiles and with vectors of very different lengths in a task."""
    monkeypatch.setattr(K, "TILE", (3, 7))
    rng = np.random.default_rng(size)
    at_most = [size, 1, 4_000, 2**25][:4]
    v = [[int(x) for x in rng.integers(-m, m + 1, 4 - n % 2)] for n in range(90) for m in [at_most[n % 4]]]
    ids = [*range(0, 120, 2), *range(0, 60, 2)]

    def blocks(of):
        made = [K._build(None)((pa.scalar(b),), pa.table({"id": pa.array([ids[n] for n in of if n % 4 == b], pa.int64()), "v": pa.array([v[n] for n in of if n % 4 == b], pa.list_(pa.int64()))})) for b in range(4)]
        return pa.concat_tables(made)

    asked = range(0, 60, 3)
    found = defaultdict(list)
    for row in K._search(3)(blocks(range(90)), blocks(asked)).to_pylist():
        found[row["query_id"]].append((-((row["high"] << 63) + row["low"]), row["vec_id"]))
    for n in asked:
        want = sorted((-sum(a * b for a, b in zip(v[n], w, strict=False)), i) for i, w in zip(ids, v, strict=True) if i != ids[n])[:3]
        assert sorted(found[ids[n]])[:3] == want


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(-300, 300), min_size=3, max_size=3), min_size=1, max_size=40), st.lists(st.integers(-300, 300), min_size=3, max_size=3), st.integers(1, 6))
def test_bit_slices(vectors, query, k):
    q = np.array(vectors)
    low, bits, slices = K.slices_of(q)
    ids = np.arange(len(q)) * 2
    got = K.block_best(1, query, ids, low, bits, 3, [int.from_bytes(s, "little") for s in slices], k)
    want = sorted((-int(v @ np.array(query)), int(i)) for v, i in zip(q, ids, strict=True))[:k]
    assert sorted((-s, i) for s, i in got) == want


DOCS = "doc_id long, text string, source string, lang string, n_chars long, size string, target int"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, s, None, 1, "z", 3) for i, t, s in rows], DOCS)


MIXED = [(i, "w " * (i % 17), ["a", "b", "c", "d", None, "Z", "é"][i * i % 7]) for i in range(500)] + [(1000, "x " * 20_000, "d"), (1001, None, "e"), (1002, "", None), (None, "p q", "a"), (3, "w w w", "b"), (3, "w w w", "b")]


def brute_targets(size):
    order = sorted(size, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, free, left = {}, set(size), float(sum(size.values()))
    while free:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        full = {s for s in free if share[s] >= 3 * size[s]}
        if not full:
            return target | share
        for s in full:
            target[s] = 3.0 * size[s]
            left -= target[s]
        free -= full
    return target


def test_mix(spark):
    rows = [r.asDict() for r in M.mix(docs(spark, MIXED)).collect()]
    assert len(rows) == len(MIXED)
    size, taken = defaultdict(int), defaultdict(int)
    for _, t, s in MIXED:
        size[s] += len((t or "").split())
    want = brute_targets(size)
    for r in rows:
        taken[r["source"]] += r["taken"]
        assert 0 <= r["taken"] <= 3 * r["size"] and r["source_size"] == size[r["source"]]
        assert math.isclose(r["target"], want[r["source"]], rel_tol=1e-9, abs_tol=1e-9)
        assert (r["first_position"] is None) == (r["taken"] == 0)
        assert r["taken"] == 0 or 0 <= r["first_position"] <= r["last_position"] <= 1
    assert {s: math.floor(t + 0.5) for s, t in want.items()} == dict(taken)
    key = lambda r: str(sorted(r.items(), key=str))
    assert sorted(map(key, rows)) == sorted(key(r.asDict()) for r in M.mix(docs(spark, MIXED[::-1])).collect())


def test_schedule(spark):
    """Positions are the inverse of the integrated rates: early sources are drawn from more at first."""
    x = spark.range(1000).selectExpr("(id + 0.5D) / 1000 AS share")
    for turn, (first, last) in enumerate(M.RATES):
        from pyspark.sql import functions as F

        for r in x.select("share", M.position(F.col("share"), F.lit(turn)).alias("t")).collect():
            assert math.isclose(first * r.t + (last - first) * r.t**2 / 2, r.share, abs_tol=1e-9)


def test_mixed_documents(spark):
    from pyspark.sql import functions as F

    rows = [*MIXED, (3, "v v v", "b"), (3, "u u v", "b")]  # as long as others of the same id
    plan = {}
    for r in M.mix(docs(spark, rows)).collect():
        plan[r.doc_id, r.source, r._mark] = max(r.copies, plan.get((r.doc_id, r.source, r._mark), 0))
    got = M.mixed_documents(docs(spark, rows))
    assert got.columns == [c.split()[0] for c in DOCS.split(", ")]
    n = defaultdict(int)
    for r in got.withColumn("mark", F.xxhash64(F.coalesce("text", F.lit("")))).collect():
        n[r.doc_id, r.source, r.mark] += 1
    equal = {(r.doc_id, r.source, r.mark): r.n for r in docs(spark, rows).groupBy("doc_id", "source", F.xxhash64(F.coalesce("text", F.lit(""))).alias("mark")).agg(F.count("*").alias("n")).collect()}
    assert dict(n) == {k: v * equal[k] for k, v in plan.items() if v}
    assert M.mix(docs(spark, [])).collect() == [] and M.mixed_documents(docs(spark, [])).collect() == []


def test_bounds_against_brute_force():
    rng = np.random.default_rng(2)
    for _ in range(30):
        n = int(rng.integers(1, 9))
        longest, counts = np.sort(rng.choice(50, n, replace=False)).astype(float), rng.integers(1, 9, n).astype(float)
        for buckets in (1, 2, 3, 4):
            cost = lambda b: sum(c * min(x for x in b if x >= v) for v, c in zip(longest, counts, strict=True))  # noqa: E731, B023
            best = min(cost([*cut, longest[-1]]) for m in range(min(buckets, n)) for cut in combinations(longest[:-1], m))
            found = P.bucket_bounds(longest, counts, buckets)
            assert found == sorted(set(found)) and len(found) <= buckets and cost(found) == best


def test_pack(spark):
    rows = P.pack(docs(spark, MIXED), buckets=4, budget=64).collect()
    assert len(rows) == len(MIXED)
    batches = defaultdict(list)
    for r in rows:
        assert r.n_tokens <= r.bucket_tokens
        batches[r.bucket, r.batch].append(r)
    for members in batches.values():
        assert len(members) * members[0].bucket_tokens <= 64 or len(members) == 1
        assert sorted(m.slot for m in members) == list(range(len(members)))
    by = defaultdict(list)
    for (bucket, batch), members in batches.items():
        by[bucket].append((batch, len(members)))
    for b in by.values():
        assert [x for x, _ in sorted(b)] == list(range(len(b))) and len({n for _, n in sorted(b)[:-1]}) <= 1
    assert P.pack(docs(spark, [])).collect() == []


def test_padding_is_least(spark):
    """Of long texts of many lengths: no cut to as many buckets pads less than what pack does."""
    rng = np.random.default_rng(3)
    sizes = [int(x) for x in rng.choice([5, 40, 900, 1500, 1501, 1502, 3000, 3001, 7000], 80)]
    rows = P.pack(docs(spark, [(i, "w " * n, "a") for i, n in enumerate(sizes)]), buckets=4).collect()
    longest = sorted(set(sizes))
    cost = lambda b: sum(min(x for x in b if x >= n) for n in sizes)
    assert sum(r.bucket_tokens for r in rows) == min(cost([*cut, longest[-1]]) for cut in combinations(longest[:-1], 3))
    assert {r.doc_id: r.n_tokens for r in rows} == dict(enumerate(sizes))


def test_cuts_against_all(spark):
    """Over thousands of lengths, beyond any bins, the search by halves finds what trying every cut finds."""
    rng = np.random.default_rng(4)
    longest, counts = np.sort(rng.choice(50_000, 1500, replace=False)), rng.integers(1, 1000, 1500)
    before = np.concatenate([[0], np.cumsum(counts)])
    least = np.concatenate([[0], longest * before[1:]])
    for _ in range(3):
        total, cut = P.best_cuts(least, longest, before)
        for j in range(1, 1501):
            every = least[:j] + longest[j - 1] * (before[j] - before[:j])
            assert total[j] == every.min() and cut[j] == every.argmin()
        least = total


def test_large_components(spark):
    """Sums beyond a long: exact in rank, the nearest long in the result."""
    rows = [(50, [1e18, 1.0]), (1, [1e18, 0.5]), (2, [3e38, 0.25]), (3, [-3e38, 2.0]), (4, [1.0, 1.0]), (5, [1e12, 0.0])]
    assert [(r[2], r[3]) for r in search(spark, rows)] == [(1, 2**63 - 1), (2, 2**63 - 1), (5, 2**63 - 1), (4, 2**53 * 256 + 256 * 256), (3, -(2**63))]
