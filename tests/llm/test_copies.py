"""Exact and near copies, repeated passages."""

import random
import re
from collections import Counter, defaultdict
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pytest

from folioforge.llm import exact_dedup as E
from folioforge.llm import near_dup as N
from folioforge.llm import suffix_dedup as S
from folioforge.llm.components import connected_components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, n string"


def table(spark, rows):
    """Documents with some columns that clash with names used inside."""
    return spark.createDataFrame([(i, t, None, "s", 1, 7, "x") for i, t in rows], SCHEMA)


def prose(seed, n):
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(2, 8))) for _ in range(n))


ODD = [(1, None), (2, ""), (3, " \t\n"), (4, "a b"), (5, "ab"), (5, "ab"), (None, "ab "), (6, "ab  "), (-(2**63), "ab"), (7, "x" * 300_000), (8, "x" * 300_000 + " "), (9, " "), (10, "é"), (None, None)]


def test_exact_against_brute_force(spark):
    groups = defaultdict(list)
    for i, t in ODD:
        groups["".join(c for c in t or "" if c not in " \t\n\x0b\x0c\r")].append((-len(t or ""), i is None, i or 0, i))
    want = sorted(str((i, min(g)[3], len(g), i == min(g)[3], sha256(k.encode()).hexdigest())) for k, g in groups.items() for *_, i in g)
    assert sorted(str(tuple(r)) for r in E.exact_dedup(table(spark, ODD)).collect()) == want


@pytest.mark.parametrize("dedup", [E.exact_dedup, N.classes, S.repeated_passages])
def test_empty_table(spark, dedup):
    assert dedup(table(spark, [])).collect() == []


def test_perfect_hash():
    digests = np.frombuffer(b"".join(sha256(str(i).encode()).digest() for i in range(5000)), np.uint8).reshape(-1, 32)
    levels, sizes, slots = E.perfect_hash(digests)
    assert sorted(slots) == list(range(5000))
    assert (E.slots_of(digests, levels, sizes) == slots).all()
    others = np.frombuffer(b"".join(sha256(f"o{i}".encode()).digest() for i in range(5000)), np.uint8).reshape(-1, 32)
    at = E.slots_of(others, levels, sizes)
    back = np.empty(5000, np.int64)
    back[slots] = np.arange(5000)
    assert not (digests[back[at[at >= 0]]] == others[at >= 0]).all(axis=1).any()  # bytes tell members from others


def test_lookup_takes_the_better_winner(spark):
    rows = lambda *r: spark.createDataFrame([(i, p, sha256(d).digest()) for i, p, d in r], "id long, points long, digest binary")
    found = E.lookup(E.build_index(rows((1, 5, b"a"), (2, 5, b"a"), (3, 1, b"b")), 4), rows((9, 6, b"a"), (0, 1, b"b"), (4, 1, b"c")), 4).collect()
    assert sorted((r.id, r.points, r.n) for r in found) == [(0, 1, 2), (4, 1, 1), (9, 6, 3)]


def shingles_of(text):
    """Its shingles with their counts, as strings."""
    words = re.findall(r"(?:[0-9a-z]|[^\x00-\x7f])+", text.lower())
    runs = [" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))] if words else []
    return words, Counter(runs)


def keys_of(spark, rows):
    """The buckets of each document."""
    batch = pa.RecordBatch.from_pydict({"id": [i for i, _ in rows], "text": [t for _, t in rows]})
    signed = pa.Table.from_batches(N._signer(N.idf_of(table(spark, rows).select("text")))([batch])).to_pylist()
    return {r["id"]: {(k, r[k]) for k in N.KEYS} for r in signed}


def brute_classes(rows, keys=None):
    """With keys, of pairs that share a bucket only. Classes by all pairs, over shingles as strings, with weights from counts of all documents. Kin are told by the
    operator's own hashes, as any other choice gives other kin."""
    own = {i: shingles_of(t or "") for i, t in rows}
    hashed = {i: next(iter(N.sorted_shingles([t]))) for i, t in rows}
    kins = {i: [k for k in N.kin(1, s, of)[0].tolist() if k >= 0] for i, (_, s, of, *_) in hashed.items()}
    size = Counter(k for x in kins.values() for k in x)
    every = sum(bool(x) for x in kins.values())
    one = {i: 1 / max([size[k] for k in x if size[k] > max(1, N.HEAVY * every)], default=1) for i, x in kins.items()}
    df, total = defaultdict(float), sum(one[i] for i in one if own[i][0]) + 1 / N.COMMON
    for i, (_, c) in own.items():
        for s in c:
            df[s] += one[i]
    idf = {s: min(1.0, max(N.LOWEST, np.log(n / total) / np.log(N.COMMON))) for s, n in df.items()}
    weight = {i: {s: int(np.log2(n) + 1) * idf[s] for s, n in c.items()} for i, (_, c) in own.items()}
    whole = {i: sum(w.values()) for i, w in weight.items()}
    root = {i: i for i in own}
    find = lambda i: i if root[i] == i else find(root[i])
    for a in own:
        for b in own:
            if a < b and (keys is None or keys[a] & keys[b]):
                x, y = weight[a], weight[b]
                both = sum(min(w, y[s]) for s, w in x.items() if s in y) if min(whole[a], whole[b]) >= 0.79 * max(whole[a], whole[b]) else 0
                if own[a][0] == own[b][0] or both and both / (whole[a] + whole[b] - both) >= 0.8 - 1e-6:
                    p, q = sorted((find(a), find(b)))
                    root[q] = p
    return {i: find(i) for i in own}


def edited(text, n, seed):
    r, w = random.Random(seed), text.split()
    for i in r.sample(range(len(w)), n):
        w[i] = prose(seed * 31 + i, 1)
    return " ".join(w)


def test_near_copies_against_brute_force(spark, monkeypatch):
    """A family around a text that is not its first, wider than a bucket may be; chains; short texts."""
    monkeypatch.setattr(N, "MOST", 16)
    base = prose(1, 150)
    rows = [(i, prose(1000 + i, 60)) for i in range(40)]
    rows += [(100 + i, edited(base, 2 + i % 4, i + 1)) for i in range(60)] + [(170, base)]
    rows += [(200, "one two"), (201, "One, two!"), (202, "one two three"), (203, prose(7, 5)), (204, ""), (205, None), (206, "!!!")]
    rows += [(300, prose(3, 40) + " " + prose(4, 400)), (301, prose(4, 400) + " " + prose(5, 40)), (302, prose(4, 400))]
    got = {r.doc_id: r.class_id for r in N.classes(table(spark, rows)).collect()}
    assert got == brute_classes([(i, t or "") for i, t in rows])


def test_large_buckets_against_brute_force(spark, monkeypatch):
    """Pairs of near copies in a family that shares most of each text without being similar, wider than a bucket may be."""
    monkeypatch.setattr(N, "MOST", 6)
    base, rows = prose(1, 400), []
    for i in range(120):
        own = base + " " + prose(500 + i, 8)
        rows += [(2 * i, edited(own, 5, 3 * i + 1)), (2 * i + 1, edited(own, 5, 3 * i + 2))]
    want = brute_classes(rows)
    assert 60 < len(set(want.values())) < 230
    assert {r.doc_id: r.class_id for r in N.classes(table(spark, rows)).collect()} == want


def test_original_of_a_large_group(spark, monkeypatch):
    """Copies that are similar to hardly more than their original; others, close to it and before it, are in all its buckets."""
    monkeypatch.setattr(N, "MOST", 4)
    base = prose(2, 400)
    rows = [(i, edited(base, 1, 7 * i + 1)) for i in range(20)] + [(20 + i, edited(base, 8, 7 * i + 1000)) for i in range(120)] + [(1000, base)]
    got, keys = {r.doc_id: r.class_id for r in N.classes(table(spark, rows)).collect()}, keys_of(spark, rows)
    assert got == brute_classes(rows, keys)
    assert sum(got[i] != c for i, c in brute_classes(rows).items()) <= 2  # what banding misses


def test_a_repeated_line_makes_no_copies(spark):
    """Different texts filled with the same line stay apart; edited copies of such a text do not."""
    line = prose(50, 8) + " "
    rows = [(i, prose(60 + i, 50) + " " + line * 60 + prose(80 + i, 50)) for i in range(6)]
    rows += [(10, edited(rows[0][1], 2, 9)), (11, "so " * 500 + prose(90, 40)), (12, "so " * 500 + prose(91, 40))]
    got = {r.doc_id: r.class_id for r in N.classes(table(spark, rows)).collect()}
    assert got == {**{i: i for i in range(6)}, 10: 0, 11: 11, 12: 12} == brute_classes(rows)


def test_near_copies_odd_rows(spark):
    got = [tuple(r) for r in N.classes(table(spark, ODD)).collect()]
    assert len(got) == len(ODD) and all(k for i, _, k in got if i is None)
    assert {i: c for i, c, _ in got if i is not None} == {1: 1, 2: 1, 3: 1, 4: 4, 5: -(2**63), 6: -(2**63), -(2**63): -(2**63), 7: 7, 8: 7, 9: 9, 10: 10}


def test_real_near_copies(spark):
    from conftest import SF

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert {r.doc_id: r.class_id for r in N.classes(docs).collect()} == brute_classes(rows)


def test_samples_agree_like_similarity():
    """Consistent weighted samples of two texts agree about as often as they are similar: with weights, that differ between texts too."""
    rng = np.random.default_rng(0)
    agree, want = [], []
    for step in range(60):
        common, a, b = (rng.integers(0, 2**48, n).astype(np.uint64) for n in (60, 20, 20))
        idf = lambda e: np.where(e % np.uint64(3) == 0, 0.15, 1.0)
        twice = 1 + (rng.random(60) < 0.3 * (step % 2))  # in the second text some of the common ones occur more often
        x, wx = np.concatenate([common, a]), np.concatenate([idf(common), idf(a)])
        y, wy = np.concatenate([common, b]), np.concatenate([idf(common) * twice, idf(b)])
        agree.append((N.samples(x, wx, np.array([0])) == N.samples(y, wy, np.array([0]))).mean())
        both = np.minimum(wx[:60], wy[:60]).sum()
        want.append(both / (wx.sum() + wy.sum() - both))
    assert abs(np.mean(agree) - np.mean(want)) < 0.02
    plain = rng.integers(0, 2**48, 500).astype(np.uint64)
    assert (N.samples(plain, None, np.array([0, 200])) == N.samples(plain, np.ones(500), np.array([0, 200]))).all()


def test_octaves():
    n = np.arange(1, 5000)
    assert (N.octaves(n) == [int(x).bit_length() for x in n]).all()


def test_common_shingles_weigh_less(spark):
    line = prose(9, 12)
    rows = [(i, prose(i, 30) + (" " + line if i % 2 else "")) for i in range(300)]
    idf = N.idf_of(table(spark, rows).select("text"))
    assert len(idf.shingle) == 8 and ((0.1 < idf.weight) & (idf.weight < 0.4)).all() and len(set(idf.weight.tolist())) == 1


def test_kin_count_once(spark):
    """The edited copies that are most of a table keep the weight of their own text; a line of as many unrelated texts loses it."""
    base = prose(3, 300)
    rows = [(i, edited(base, 3, i + 1)) for i in range(200)] + [(1000 + i, prose(2000 + i, 60)) for i in range(100)]
    assert not len(N.idf_of(table(spark, rows).select("text")).shingle)


def test_summary_finds_what_is_common(spark, monkeypatch):
    """With few counters and many partitions all that is common is found still, and counted exactly."""
    monkeypatch.setattr(N, "COUNTERS", 8)
    line = prose(9, 12)
    rows = [(i, prose(i, 20) + (" " + line if i % 10 == 0 else "")) for i in range(600)]
    want = N.idf_of(table(spark, rows).select("text"))
    got = N.idf_of(table(spark, rows).select("text").repartition(37))
    assert len(want.shingle) == 8 and (got.shingle == want.shingle).all() and (got.weight == want.weight).all()


def test_components(spark):
    links = [(i, i + 1) for i in range(0, 30)] + [(50, i) for i in range(51, 80)] + [(80, 51), (5, 5), (90, 91), (91, 90)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(31)}, **{i: 50 for i in range(50, 81)}, 90: 90, 91: 90}


def brute_passages(rows):
    """The words of each document that are in a window of LEAST words that occurs twice, and the places of each such window."""
    where, covered = defaultdict(set), defaultdict(set)
    for i, t in rows:
        if i is not None:
            w = (t or "").split()
            for a in range(len(w) - S.LEAST + 1):
                where[tuple(w[a : a + S.LEAST])].add((i, a))
    places = [p for p in where.values() if len(p) > 1]
    for p in places:
        for i, a in p:
            covered[i].update(range(a, a + S.LEAST))
    return dict(covered), places


def passages(spark, rows, cut=None):
    docs = table(spark, rows)
    found = S.repeated_passages(docs.repartition(cut) if cut else docs).collect()
    got = defaultdict(set)
    for r in found:
        got[r.doc_id].update(range(r.start_word, r.end_word))
    return dict(got), found


def kept_once(found, places):
    """Of every repeated window, each word of some occurrence is left if what repeats is deleted."""
    gone = defaultdict(set)
    for r in found:
        if r.repeats:
            gone[r.doc_id].update(range(r.start_word, r.end_word))
    for r in found:
        if not r.repeats:
            gone[r.doc_id] -= set(range(r.start_word, r.end_word))
    return all(any(not gone[i] & set(range(a, a + S.LEAST)) for i, a in p) for p in places)


def test_passages_against_brute_force(spark):
    p, q = prose(1, 51), prose(2, 130)
    rows = [(i, prose(50 + i, 80)) for i in range(20)]
    rows += [(30, prose(60, 9) + " " + p + " " + prose(61, 40)), (31, p), (32, prose(62, 30) + " " + p), (33, q + " " + q), (34, prose(63, 20) + " " + q[: len(q) // 2])]
    rows += [(40, " ".join(prose(2, 130).split()[:49])), (41, None), (42, ""), (None, q), (43, "w " * 120), (31, p), (44, prose(64, 60) + "\n" + p)]
    want, places = brute_passages(rows)
    got, found = passages(spark, rows)
    assert got == want and kept_once(found, places)
    assert not any(r.repeats for r in found if r.doc_id == 30) and all(r.repeats for r in found if r.doc_id in (32, 44))


def test_first_is_of_the_passage(spark):
    """The minimiser's words stand alone in earlier documents; of the passage itself the first stays."""
    p = prose(5, 60).split()
    rows = [(i, prose(300 + i, 55) + " " + " ".join(p[max(0, i - 3) : i + 22]) + " " + prose(400 + i, 55)) for i in range(0, 48, 4)]
    rows += [(100, prose(7, 30) + " " + " ".join(p)), (101, " ".join(p) + " " + prose(8, 30))]
    got, found = passages(spark, rows)
    assert got == brute_passages(rows)[0] and {r.doc_id: r.repeats for r in found} == {100: False, 101: True}


@pytest.mark.parametrize("batch,partitions", [(16, 1), (10_000, 40)])
def test_crowded_minimiser(spark, batch, partitions):
    """Repeats that end with a line of many texts are found whatever the batches and partitions."""
    line = prose(9, 14)
    rows = [(i, prose(600 + i, 50) + " " + line + (" " + prose(5000 + i, 3) if i % 3 else "")) for i in range(250)]
    for k in range(20):
        own = prose(9000 + k, 45)
        rows += [(1000 + 2 * k, prose(7000 + k, 9) + " " + own + " " + line), (1001 + 2 * k, own + " " + line + " " + prose(8000 + k, 4))]
    rows += [(2000 + i, prose(9500, 40) + " " + line + " " + prose(9600 + i, 2)) for i in range(3)]
    old = {c: spark.conf.get(c) for c in ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.shuffle.partitions")}
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        got, found = passages(spark, rows)
    finally:
        for c, v in old.items():
            spark.conf.set(c, v)
    want, places = brute_passages(rows)
    assert got == want and kept_once(found, places)
    assert sum(i >= 1000 for i in got) >= 40


def test_real_passages(spark):
    from conftest import SF

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    got = defaultdict(set)
    for r in S.repeated_passages(docs).collect():
        got[r.doc_id].update(range(r.start_word, r.end_word))
    text = [(i, re.sub(r"[^\x20\x09-\x0D]+", lambda m: "x" + m[0].encode("utf-8").hex(), t or "")) for i, t in rows]  # words by white space of ASCII alone
    assert dict(got) == brute_passages(text)[0]


def test_summary_of_few_texts_leaves_out_what_is_rare():
    """However few texts a partition has, a shingle of one of them is not handed on, and what is left out is told."""
    summary = N.Summary()
    summary.texts = 240.0 * N.UNIT
    summary.add(np.arange(1000, dtype=np.uint64), np.full(1000, float(N.UNIT)))
    summary.add(np.array([7], np.uint64), np.array([4.0 * N.UNIT]))
    summary.closed()
    assert summary.item.tolist() == [7] and summary.count.tolist() == [5.0 * N.UNIT]
    assert summary.missed == N.UNIT <= N.COMMON / 4 * summary.texts
