"""Toxicity of whole texts by a lexicon that also meets misspelled terms.

The lexicon is learned: terms (words, or stems where many words go on from the same letters) that cover the toxic
training texts and hardly occur in the others. It is a trie; a Levenshtein automaton that allows swapped neighbours
runs along it, and their product is determinised as words are read, so that after a while a word costs a dictionary
lookup for each of its first few letters. Words known from harmless texts are never misspellings.

Every hit is judged in its context window: inside quotation marks or after words of reporting it counts as quoted,
beside words of address as aimed. A logistic model over counts of these gives the score; quoted hits pull it down
from the start, however few the training texts tell about them.

Labels are learned only from rows where crc32(id as text) mod 4 is not 2, at most SAMPLE of them, chosen by a hash of
the id: a bound on what training holds, and so on the candidate terms, the words of harmless texts and the features that
come to the driver. Every text is scored whole, very long ones too; what a task has determinised of the automaton is
forgotten beyond STATES states, which changes no score. Other columns are not read. An empty table gives an empty result. Null and empty texts have no hits and get the
score of such texts; without any usable label the lexicon is empty and all scores are equal. Repeated rows are scored
each for itself; an id labelled more than once counts as toxic if any label says so.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, written

SAMPLE = 20_000
#: States of the product automaton that a task keeps.
STATES = 100_000
#: A term that one in so many toxic texts has stands for itself; rarer ones must cover texts without any.
OFTEN = 25
THRESHOLD = 0.3
TOKEN = re.compile(r"\w+(?:[@$!*]+\w+)*")
LEET = str.maketrans("013457@$!", "oieastasi")
STEM_LEAST, PREFIX_MOST = 4, 9
WINDOW = 60
REPORTED = re.compile(r"\b(?:said|says|quot\w*|called|calling|term|word|slur|wrote|writes|dit|dijo|sagte|mot|palabra|wort)\b")
AIMED = re.compile(r"\b(?:you|your|youre|u|du|dich|dein|ihr|tu|toi|vous|votre|te|eres|usted|vosotros)\b")
OPENING, CLOSING = "\"“«„‘", "\"”»“’"
FEATURES = ("any", "plain", "density", "near", "stem", "kinds", "quoted", "all_quoted", "aimed")
#: Where the weights go without evidence, the constant last.
PRIOR = np.array([2.0, 1.0, 0.2, 0.3, 0.5, 0.5, -0.5, -2.0, 0.5, -3.0])


class Lexicon:
    """Entries (term, is_stem) as a trie, and its product with the Levenshtein automaton.

    A state is what may have been read so far: nodes of the trie, each with the least number of edits, and swaps of
    which the second letter is due. Whole words of 5 letters or more may have one edit, of 9 or more two; stems none
    below 7 letters.
    """

    def __init__(self, entries: list[tuple[str, bool]], known: frozenset[str] = frozenset()) -> None:
        self.entries, self.known = entries, known
        self.child: list[dict[str, int]] = [{}]
        self.ends: list[list[int]] = [[]]
        self.allowed = [0]
        self.allow = [self.edits(*e) for e in entries]
        for i, (term, _) in enumerate(entries):
            node = 0
            self.allowed[0] = max(self.allowed[0], self.allow[i])
            for c in term:
                if c not in self.child[node]:
                    self.child[node][c] = len(self.child)
                    self.child.append({})
                    self.ends.append([])
                    self.allowed.append(0)
                node = self.child[node][c]
                self.allowed[node] = max(self.allowed[node], self.allow[i])
            self.ends[node].append(i)
        self.forget()

    def forget(self) -> None:
        """Begins with the start state alone; states come back as words need them."""
        self.states: dict[tuple, int] = {}
        self.members: list[tuple] = []
        self.next: list[dict[str, int]] = []
        self.found: list[tuple[int, int] | None] = []
        self.start = self._state({(0, ""): 0}) if self.entries else -1

    def __reduce__(self) -> tuple:
        return Lexicon, (self.entries, self.known)

    @staticmethod
    def edits(term: str, stem: bool) -> int:
        return int(len(term) >= 7) if stem else int(len(term) >= 5) + int(len(term) >= 9)

    def _state(self, reached: dict[tuple[int, str], int]) -> int:
        work = list(reached.items())
        while work:  # letters of the term that the word leaves out
            (node, due), e = work.pop()
            if not due:
                for n in self.child[node].values():
                    if e + 1 <= self.allowed[n] and e + 1 < reached.get((n, ""), 9):
                        reached[n, ""] = e + 1
                        work.append(((n, ""), e + 1))
        key = tuple(sorted((n, d, e) for (n, d), e in reached.items()))
        if not key:
            return -1
        if key not in self.states:
            self.states[key] = len(self.members)
            self.members.append(key)
            self.next.append({})
            hits = [(e, i) for n, d, e in key if not d for i in self.ends[n] if e <= self.allow[i]]
            self.found.append(min(hits) if hits else None)
        return self.states[key]

    def _step(self, state: int, c: str) -> int:
        reached: dict[tuple[int, str], int] = {}

        def reach(node: int, due: str, e: int) -> None:
            if e <= self.allowed[node] and e < reached.get((node, due), 9):
                reached[node, due] = e

        for node, due, e in self.members[state]:
            if due:
                if c == due:
                    reach(node, "", e)
                continue
            reach(node, "", e + 1)
            for letter, n in self.child[node].items():
                reach(n, "", e + (letter != c))
                if c != letter and c in self.child[n]:
                    reach(self.child[n][c], letter, e + 1)
        to = self.next[state][c] = self._state(reached)
        return to

    def match(self, word: str) -> tuple[int, int] | None:
        """(edits, entry) of the best entry that a word in lower case is, or is a misspelling of; a word that continues a stem is one of it."""
        if len(self.members) > STATES:
            self.forget()
        state, stem = self.start, None
        for c in word:
            if state < 0:
                break
            to = self.next[state].get(c)
            state = self._step(state, c) if to is None else to
            if state >= 0 and (f := self.found[state]) and self.entries[f[1]][1] and (stem is None or f < stem):
                stem = f
        hit = self.found[state] if state >= 0 else None
        hit = min(x for x in (hit, stem) if x) if hit or stem else None
        return None if hit is None or hit[0] and word in self.known else hit

    def look(self, word: str) -> tuple[int, int] | None:
        hit = self.match(word)
        if hit is None and not word.isalpha():
            hit = self.match(plain := re.sub(r"[^\w]", "", word.translate(LEET)))
            hit = (max(1, hit[0]), hit[1]) if hit and plain not in self.known else None
        return hit


def quoted(low: str, start: int, end: int) -> bool:
    before, after = low[max(0, start - WINDOW) : start], low[end : end + WINDOW]
    for o, c in zip(OPENING, CLOSING, strict=True):
        opened = before.count(o) % 2 == 1 if o == c else before.rfind(o) > before.rfind(c)
        if opened and c in after:
            return True
    return bool(REPORTED.search(before[-30:]))


def features(text: str, lexicon: Lexicon) -> list[float]:
    low = text.lower()
    words = TOKEN.findall(low)
    hits = {w: h for w in set(words) if (h := lexicon.look(w))}
    if not hits:
        return [0.0] * len(FEATURES)
    n = near = stem = said = aimed = 0
    for m in TOKEN.finditer(low):
        if h := hits.get(m[0]):
            n += 1
            near += h[0] > 0
            stem += lexicon.entries[h[1]][1]
            said += quoted(low, *m.span())
            aimed += bool(AIMED.search(low[max(0, m.start() - WINDOW) : m.end() + WINDOW]))
    plain = n - said
    return [float(plain > 0), np.log1p(plain), min(5.0, 100.0 * plain / len(words)), np.log1p(near), np.log1p(stem), np.log1p(len({h[1] for h in hits.values()})), np.log1p(said), float(plain == 0), np.log1p(aimed)]


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, prior: np.ndarray, strength: float = 1.0) -> np.ndarray:
    """Weights of a logistic model, the constant last, drawn to the prior; Newton's method."""
    x1, w = np.hstack([x, np.ones((len(x), 1))]), prior.copy()
    for _ in range(30):
        p = sigmoid(x1 @ w)
        step = np.linalg.solve((x1 * (p * (1 - p))[:, None]).T @ x1 + strength * np.eye(len(w)), x1.T @ (p - y) + strength * (w - prior))
        w = w - step
        if np.abs(step).max() < 1e-6:
            break
    return w


def held_out(id_col: Column) -> Column:
    return F.crc32(id_col.cast("string").cast("binary")) % 4 == 2


def prefixes(word: str) -> Iterator[str]:
    yield word + "$"
    for n in range(STEM_LEAST, min(len(word), PREFIX_MOST) + 1):
        yield word[:n]


def _terms(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In how many toxic and harmless texts of the partition each word (with $) and each beginning occurs."""
    counts = (Counter(), Counter())
    for batch in rows:
        for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
            counts[toxic].update({p for w in set(TOKEN.findall((text or "").lower())) for p in prefixes(w)})
    terms = list(counts[0] | counts[1])
    for i in range(0, len(terms), 50_000):
        part = terms[i : i + 50_000]
        yield pa.RecordBatch.from_arrays([pa.array(part), *(pa.array([c[t] for t in part], pa.int64()) for c in (counts[1], counts[0]))], names=["term", "toxic", "clean"])


def settle(counts: dict[str, int]) -> dict[str, str]:
    """For each candidate the longest one that nearly as many toxic texts have: a stem goes on while its words agree."""
    ordered, found = sorted(counts), {}
    follow: dict[str, list[str]] = {}
    for t in ordered:
        if not t.endswith("$"):
            follow.setdefault(t[:-1], []).append(t)
        else:
            follow.setdefault(t[:-1][:PREFIX_MOST], []).append(t)
    for t in ordered:
        at = t
        while not at.endswith("$") and (n := max((x for x in follow.get(at, ()) if x != at), key=lambda x: counts[x], default=None)) and counts[n] >= 0.95 * counts[t]:
            at = n
        found[t] = at
    return found


def cover(texts: list[set[str]], terms: list[str], often: int, least: int) -> list[str]:
    """The terms of often or more texts, and then some that cover the other texts, the one with most uncovered texts
    first, while it adds least or more. Of a term and its beginning the beginning is enough."""
    where: dict[str, set[int]] = {t: set() for t in terms}
    for i, have in enumerate(texts):
        for t in have:
            where[t].add(i)
    chosen, heap = [t for t in sorted(terms, key=lambda t: (len(t), t)) if len(where[t]) >= often], sorted(terms)
    chosen = [t for t in chosen if not any(t != c and t.startswith(c) for c in chosen)]
    left = set(range(len(texts))).difference(*(where[t] for t in chosen))
    while heap:
        best = max(heap, key=lambda t: (len(where[t] & left), -len(t), t))
        if len(where[best] & left) < least:
            break
        chosen.append(best)
        left -= where[best]
        heap = [t for t in heap if t != best and len(where[t] & left) >= least]
    return chosen


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[Lexicon, np.ndarray]:
    """The lexicon and the weights, from labels (doc_id, toxic) and docs (doc_id, text)."""
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = docs.join(F.broadcast(known), "doc_id").select("text", (F.col("toxic") > 0).cast("int").alias("toxic"))
    rows = written(rows.dropDuplicates(["text", "toxic"]), "toxic-sample")
    size = {r.toxic: r["count"] for r in rows.groupBy("toxic").count().collect()}
    if not size.get(1) or not size.get(0):
        return Lexicon([]), PRIOR
    least = max(3, size[1] // 100)
    counts = written(rows.mapInArrow(_terms, "term string, toxic long, clean long").groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")), "toxic-terms")
    odds = F.col("toxic") / float(size[1]) / ((F.col("clean") + 0.5) / float(size[0]))
    candidates = {r.term: r.toxic for r in counts.where((F.col("toxic") >= least) & (odds > 20) & (F.length("term") > 3)).collect()}
    end = settle(candidates)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([sorted({end[p] for w in set(TOKEN.findall((t or "").lower())) for p in prefixes(w) if p in end}) for t in batch.column(0).to_pylist()], pa.list_(pa.string()))], names=["terms"])

    texts = [set(r.terms) for r in rows.where("toxic = 1").select("text").mapInArrow(of, "terms array<string>").collect()]
    chosen = cover(texts, sorted(set(end.values())), max(3, size[1] // OFTEN), least)
    entries = [(t[:-1], False) if t.endswith("$") else (t, True) for t in chosen]
    fuzzy = Lexicon(entries)

    def harmless(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([t[:-1] for t in batch.column(0).to_pylist() if (h := fuzzy.match(t[:-1])) and h[0]], pa.string())], names=["word"])

    seen = counts.where((F.col("clean") > 0) & F.endswith(F.col("term"), F.lit("$"))).select("term").mapInArrow(harmless, "word string")
    lexicon = Lexicon(entries, frozenset(r.word for r in seen.collect()))

    found = rows.select("toxic", "text").mapInArrow(_scorer(lexicon, None), "toxic int, features array<double>").collect()
    return lexicon, fit(np.array([r.features for r in found]), np.array([r.toxic for r in found], float), PRIOR)


def _scorer(lexicon: Lexicon, weights: np.ndarray | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([features(t or "", lexicon) for t in batch.column(1).to_pylist()]).reshape(-1, len(FEATURES))
            if weights is None:
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(x.tolist(), pa.list_(pa.float64()))], names=["toxic", "features"])
            else:
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sigmoid(x @ weights[:-1] + weights[-1]))], names=["doc_id", "score"])

    return run


def score(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    lexicon, weights = train(docs, labels.select("doc_id", "toxic"), sample)
    scored = docs.mapInArrow(_scorer(lexicon, weights), "doc_id long, score double")
    return scored.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The documents that are not predicted toxic, with their columns, in one pass over the texts."""
    lexicon, weights = train(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), labels.select("doc_id", "toxic"), sample)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([features(t or "", lexicon) for t in batch.column(at).to_pylist()]).reshape(-1, len(FEATURES))
            yield batch.filter(pa.array(sigmoid(x @ weights[:-1] + weights[-1]) < THRESHOLD))

    return docs.mapInArrow(run, docs.schema)


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
