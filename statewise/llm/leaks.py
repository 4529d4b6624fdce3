"""Evaluation passages inside the corpus (problem 7): a BM25 index of the test items, asked with every training passage."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statewise.llm.mail import folded, texts

WORD = re.compile(r"[^\W_]+")
CJK = re.compile(r"[぀-ヿ㐀-䶿一-鿿豈-﫿]")
#: Consecutive words, and consecutive characters of texts in Chinese or Japanese, that make a leak.
WORDS, CHARS = 13, 20
K1, B = 1.2, 0.75
#: Items of one interval, for which every term keeps its largest impact.
BLOCK = 32
#: Items per index; a larger test set is asked index by index, in passes over the corpus.
ITEMS = 50_000


class Index:
    """Inverted index of items over terms, with the largest impact of each term in each interval of BLOCK items (block-max WAND on intervals).

    ``span`` consecutive units make a leak. Words are their own terms; characters are indexed by pairs. An item's ``floor`` is the least
    score that any run of ``span`` of its units gives it, so every passage that holds such a run scores at least that.
    """

    def __init__(self, items: list[tuple[int, list[str]]], span: int, pairs: bool):
        self.span, self.pairs = span, pairs
        self.ids = [k for k, u in items if len(u) >= span]
        self.units = [u for _, u in items if len(u) >= span]
        self.runs = [{" ".join(u[i : i + span]) for i in range(len(u) - span + 1)} for u in self.units]
        terms = [self.terms(u) for u in self.units]
        mean = sum(map(len, terms)) / max(1, len(terms))
        df = Counter(t for ts in terms for t in set(ts))
        self.vocab = {t: n for n, t in enumerate(sorted(df))}
        idf = {t: math.log(1 + (len(terms) - n + 0.5) / (n + 0.5)) for t, n in df.items()}
        postings: list[list[tuple[int, float]]] = [[] for _ in self.vocab]
        floor: list[float] = []
        width = span - pairs
        for k, ts in enumerate(terms):
            norm = K1 * (1 - B + B * len(ts) / mean)
            impact = {t: idf[t] * n * (K1 + 1) / (n + norm) for t, n in Counter(ts).items()}
            for t, x in impact.items():
                postings[self.vocab[t]].append((k, x))
            floor.append(min(sum(impact[t] for t in set(ts[i : i + width])) for i in range(len(ts) - width + 1)) - 1e-6)
        self.floor = np.array(floor)
        self.items = [np.array([k for k, _ in p], np.int32) for p in postings]
        self.impacts = [np.array([x for _, x in p], np.float64) for p in postings]
        self.intervals, self.most = [], []
        for at, x in zip(self.items, self.impacts, strict=True):
            some, first = np.unique(at // BLOCK, return_index=True)
            self.intervals.append(some)
            self.most.append(np.maximum.reduceat(x, first))
        self.least = np.minimum.reduceat(self.floor, np.arange(0, len(floor), BLOCK)) if floor else self.floor

    def terms(self, units: list[str]) -> list[str]:
        return [a + b for a, b in zip(units, units[1:], strict=False)] if self.pairs else units

    def above(self, query: list[int]) -> np.ndarray:
        """Every item whose score for the query's (different) terms reaches its floor.

        The largest impacts of the terms bound the score of every item of an interval; intervals whose bound is below the least floor of
        their items are skipped, the postings of the others are scored.
        """
        some = np.concatenate([self.intervals[t] for t in query])
        bound = np.bincount(some, np.concatenate([self.most[t] for t in query]), len(self.least))
        live = bound >= self.least
        if not live.any():
            return np.empty(0, np.int64)
        at, x = np.concatenate([self.items[t] for t in query]), np.concatenate([self.impacts[t] for t in query])
        if not live.all():
            inside = live[at // BLOCK]
            at, x = at[inside], x[inside]
        return np.flatnonzero(np.bincount(at, x, len(self.floor)) >= self.floor)

    def holds(self, spoken: list[str], item: int, inserted: int) -> bool:
        """Whether ``spoken`` holds ``span`` consecutive units of the item in order, with at most ``inserted`` other units between them."""
        places: dict[str, list[int]] = {}
        for p, u in enumerate(self.units[item]):
            places.setdefault(u, []).append(p)
        ends: dict[tuple[int, int], list[int]] = {}  # (place in the passage, in the item) -> longest run by units inserted
        for i, u in enumerate(spoken):
            for p in places.get(u, ()):
                best = [1] * (inserted + 1)
                for skip in range(inserted + 1):
                    for used, n in enumerate(ends.get((i - 1 - skip, p - 1), ())[: inserted + 1 - skip]):
                        best[used + skip] = max(best[used + skip], n + 1)
                if max(best) >= self.span:
                    return True
                ends[i, p] = best
        return False

    def leaks(self, units: list[str], inserted: int = 0) -> set[int]:
        """Places of the items of which ``units`` hold a run. Every passage is asked that can hold one: windows of two spans, one span apart,
        over stretches of indexed terms that no more than ``inserted`` other terms interrupt at once. A shorter stretch holds no run."""
        width = self.span - self.pairs
        if len(units) < self.span or not self.ids:
            return set()
        terms = self.terms(units)
        known = np.fromiter(map(self.vocab.get, terms, repeat(-1)), np.int32, len(terms))
        if inserted:
            at = np.flatnonzero(known >= 0)
            breaks = np.flatnonzero(np.diff(at) > inserted * (1 + self.pairs) + 1)
            stretches = [(int(at[a]), int(at[z - 1]) + 1) for a, z in zip(np.r_[0, breaks + 1].tolist(), np.r_[breaks + 1, len(at)].tolist(), strict=True) if z > a]
        else:
            gap = np.flatnonzero(np.concatenate([[True], known < 0, [True]]))
            stretches = [(int(gap[k]), int(gap[k + 1]) - 1) for k in np.flatnonzero(np.diff(gap) > width).tolist()]
        found: set[int] = set()
        for start, end in stretches:
            for at in range(start, max(start + 1, end - width + 1), width):
                stop = min(end, at + 2 * width + inserted)
                query = np.unique(known[at:stop])
                hits = [i for i in self.above(query[query >= 0].tolist()).tolist() if i not in found]
                if hits and inserted:
                    passage = units[at : stop + self.pairs]
                    found.update(i for i in hits if self.holds(passage, i, inserted))
                elif hits:
                    spoken = {" ".join(units[i : i + self.span]) for i in range(at, stop - width + 1)}
                    found.update(i for i in hits if not spoken.isdisjoint(self.runs[i]))
        return found

    def overlap(self, units: list[str], item: int) -> tuple[int, float, float]:
        """(runs of the item in ``units``, share of the first half of the item's units that such runs cover, share of the second half)."""
        spoken = {" ".join(units[i : i + self.span]) for i in range(len(units) - self.span + 1)}
        own = self.units[item]
        covered = np.zeros(len(own), bool)
        runs = 0
        for i in range(len(own) - self.span + 1):
            if " ".join(own[i : i + self.span]) in spoken:
                covered[i : i + self.span] = True
                runs += 1
        half = (len(own) + 1) // 2
        return runs, float(covered[:half].mean()), float(covered[half:].mean()) if half < len(own) else 0.0


def units_of(text: str) -> tuple[list[str], list[str]]:
    """Words, and letters and digits one by one if the text holds Chinese or Japanese (else none)."""
    flat = folded(text)
    words = WORD.findall(flat)
    return words, list("".join(words)) if CJK.search(flat) else []


def indexes(items: Iterable[tuple[int, str]]) -> list[Index]:
    words, chars = [], []
    for k, text in items:
        w, c = units_of(text)
        letters = "".join(w)
        if len(CJK.findall(letters)) * 2 > len(letters):
            chars.append((k, c))
        else:
            words.append((k, w))
    return [Index(words, WORDS, False), Index(chars, CHARS, True)]


REPORT = "doc_id long, item_id long, runs long, question_share double, answer_share double"


def leaks(documents: DataFrame, items: DataFrame, inserted: int = 0, report: bool = False) -> DataFrame:
    """``doc_id, item_id``: every message that holds WORDS consecutive words of an item (Chinese and Japanese items: CHARS characters).

    With ``inserted`` up to so many other words may stand between them. With ``report`` also ``runs, question_share, answer_share``: how
    many of the item's runs the message holds word by word, and how much of the first half of the item (where a test item asks) and of the
    second (where it answers) they cover, each the largest of the message's texts. ``documents`` has ``doc_id, text``; ``items`` has
    ``item_id, text`` and is a fixed test set, read to the driver in indexes of ITEMS. Rows with a null id or text take no part; empty
    texts and items shorter than a run leak nothing; repeated rows count once.
    """
    rows = items.where("item_id is not null and text is not null").select(F.col("item_id").cast("long"), "text").distinct().orderBy("item_id", "text")
    chunks: list[list[tuple[int, str]]] = [[]]
    for r in rows.toLocalIterator():
        if len(chunks[-1]) == ITEMS:
            chunks.append([])
        chunks[-1].append((r[0], r[1]))
    source = documents.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sc = documents.sparkSession.sparkContext
    names = REPORT.replace(" long", "").replace(" double", "").split(", ")
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
    out = None
    for chunk in chunks:
        shared = sc.broadcast(indexes(chunk))

        def search(batches: Iterable[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            built = shared.value
            for batch in batches:
                got: list[tuple] = []
                for doc, message in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                    for text in texts(message):
                        for index, units in zip(built, units_of(text), strict=True):
                            for i in index.leaks(units, inserted):
                                got.append((doc, index.ids[i], *(index.overlap(units, i) if report else (0, 0.0, 0.0))))
                columns = list(zip(*got, strict=True)) or [()] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

        part = source.mapInArrow(search, REPORT)
        out = part if out is None else out.union(part)
    if not report:
        return out.select("doc_id", "item_id").distinct()
    shares = [F.round(F.max(c), 6).alias(c) for c in names[3:]]
    return out.groupBy("doc_id", "item_id").agg(F.max("runs").alias("runs"), *shares)


__all__ = ["Index", "indexes", "leaks", "units_of"]
