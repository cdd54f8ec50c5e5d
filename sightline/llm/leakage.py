"""Evaluation passages in a training corpus, found through a positional inverted index.

The index holds the place of every word of the corpus: shards of documents, and in each a row for each
term with its list of documents and positions, in the order of the terms. It is written once, without a
shuffle, and knows nothing of the evaluation set. A search reads the lengths of the lists of the
evaluation terms, takes the two rarest terms of each window of an item, reads their lists only, shifts each
by the term's place in the item and intersects them; only documents where both agree are then read, for
exact runs of words and for stretches with words changed, left out or added.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightline.llm.textnorm import mostly_cjk, words
from sightline.runtime import Staging

SHARD_DOCUMENTS, SHARD_WORDS = 4_096, 2_000_000  # a shard of the index ends at either
MOST_ITEM_CHARS = 100_000_000  # of all evaluation items, which the driver and each task hold
WINDOW = 6  # a stretch of 14 or more with one change in ten always holds so many words in a row unchanged


@dataclass(frozen=True)
class Item:
    item_id: int
    terms: tuple[int, ...]
    own: tuple[bool, ...]
    least: int

    @cached_property
    def arrays(self) -> tuple[np.ndarray, np.ndarray]:
        return np.array(self.terms, np.int32), np.array(self.own, bool)


@dataclass
class Lookup:
    """The evaluation side: terms, items, and the pairs of rare terms of each window."""

    terms: dict[str, int]
    items: list[Item]
    pairs: list[set[tuple[int, int]]] = field(default_factory=list)
    anchors: dict[int, list[tuple[int, int]]] = field(default_factory=dict)

    def order_by_rarity(self, occurrences: dict[int, int]) -> None:
        """Of each window, take the two rarest terms (by place, where equally rare)."""
        for n, item in enumerate(self.items):
            pairs = set()
            for start in range(len(item.terms) - WINDOW + 1):
                at = range(start, start + WINDOW)
                if all(item.own[i] for i in at):
                    first, second = sorted(at, key=lambda i: (occurrences.get(item.terms[i], 0), i))[:2]
                    pairs.add((first, second))
            self.pairs.append(pairs)
            for i in {i for p in pairs for i in p}:
                self.anchors.setdefault(item.terms[i], []).append((n, i))


def read_items(rows: Sequence[tuple[int, str | None]], least_words: int, least_cjk: int) -> Lookup:
    """Items as term numbers. A stretch as long as a passage that stands word for word in two items is nobody's own."""
    terms: dict[str, int] = {}
    lists = []
    for i, text in rows:
        ws = words(text)
        lists.append((i, [terms.setdefault(w, len(terms)) for w in ws], least_cjk if mostly_cjk(ws) else least_words))
    holders: dict[tuple[int, ...], set[int]] = {}
    for i, seq, least in lists:
        for s in range(len(seq) - least + 1):
            holders.setdefault(tuple(seq[s : s + least]), set()).add(i)
    items = []
    for i, seq, least in lists:
        own = [True] * len(seq)
        for s in range(len(seq) - least + 1):
            if len(holders[tuple(seq[s : s + least])]) > 1:
                own[s : s + least] = [False] * least
        items.append(Item(i, tuple(seq), tuple(own), least))
    return Lookup(terms, items)


INDEX = "shard long, term string, n int, docs array<int>, positions array<int>, ids array<long>"


def _shard_rows(shard: int, ids: list[int], terms: dict[str, int], codes: list[int], sizes: list[int]) -> pa.RecordBatch:
    """The rows of a shard: its lists, term by term, and one row without a term that has the ids of its documents."""
    code = np.array(codes, np.int32)
    docs = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
    starts = np.cumsum(sizes) - sizes if sizes else np.zeros(0, np.int64)
    positions = (np.arange(len(code)) - np.repeat(starts, sizes)).astype(np.int32)
    names = sorted(terms)
    place = np.empty(len(names), np.int32)
    place[[terms[t] for t in names]] = np.arange(len(names), dtype=np.int32)
    order = np.argsort(place[code], kind="stable")
    n = np.bincount(place[code], minlength=len(names)).astype(np.int32)
    ends = np.concatenate([[0], np.cumsum(n), [len(code)]]).astype(np.int32)  # the last row has no list
    lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(v[order], pa.int32())) for v in (docs, positions)]
    directory = pa.array([None] * len(names) + [ids], pa.list_(pa.int64()))
    columns = [pa.array(np.full(len(names) + 1, shard, np.int64)), pa.array([*names, None], pa.string()), pa.array(np.r_[n, 0].astype(np.int32)), *lists, directory]
    return pa.RecordBatch.from_arrays(columns, names=["shard", "term", "n", "docs", "positions", "ids"])


def build_index(documents: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``shard, term, n, docs, positions, ids``: the positional lists of all words of a corpus.

    Every document is read whole; those without an id or a word have no place in it. ``docs`` are numbers
    within the shard, whose row without a term has the documents' ids in their order.
    """

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId() << 24
        ids, terms, codes, sizes = [], {}, [], []
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ws = words(text) if doc is not None else []
                if not ws:
                    continue
                codes.extend(terms.setdefault(w, len(terms)) for w in ws)
                ids.append(doc)
                sizes.append(len(ws))
                if len(ids) >= SHARD_DOCUMENTS or len(codes) >= SHARD_WORDS:
                    yield _shard_rows(shard, ids, terms, codes, sizes)
                    shard, ids, terms, codes, sizes = shard + 1, [], {}, [], []
        if ids:
            yield _shard_rows(shard, ids, terms, codes, sizes)

    rows = documents.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(index, INDEX)


def _reach(item: Sequence[int], doc: Sequence[int], i: int, j: int, step: int, stop: int, most: int) -> list[int]:
    """Most item words used from (i, j) on in one direction, with 0 to ``most`` changes; ``stop`` ends the item.

    The furthest place on each diagonal is kept for each number of changes.
    """

    def slide(a: int, d: int) -> int:
        b = a + d
        while a < stop and 0 <= (y := j + step * b) < len(doc) and doc[y] == item[i + step * a]:
            a, b = a + 1, b + 1
        return a

    far = {0: slide(0, 0)}
    best = [far[0]]
    for _ in range(most):
        now: dict[int, int] = {}
        for d, a in far.items():
            for to, used in ((d, min(a + 1, stop)), (d - 1, min(a + 1, stop)), (d + 1, a)):
                if used > now.get(to, -1):
                    now[to] = used
        far = {d: slide(a, d) for d, a in now.items() if a + d >= 0}
        best.append(max(best[-1], max(far.values(), default=0)))
    return best


def _exact_runs(item: Item, doc: np.ndarray, diagonal: int) -> list[tuple[int, int]]:
    """(first word, end) of the item's own words that stand in the document one after another, ``WINDOW`` or more."""
    terms, own = item.arrays
    low, high = max(0, -diagonal), min(len(terms), len(doc) - diagonal)
    if high - low < WINDOW:
        return []
    same = np.zeros(high - low + 2, np.int8)
    same[1:-1] = (terms[low:high] == doc[low + diagonal : high + diagonal]) & own[low:high]
    turns = np.flatnonzero(same[1:] != same[:-1])
    return [(low + s, low + e) for s, e in zip(turns[::2].tolist(), turns[1::2].tolist(), strict=True) if e - s >= WINDOW]


def _stretch(item: Item, doc: Sequence[int], diagonal: int) -> tuple[int, int, int] | None:
    """(first word, words, changes) of the item's longest stretch allowed around exact runs on a diagonal.

    A stretch of c changes has c + 1 runs of (10 c - c) words or more together, so around one of them
    ``least // 10 + 1`` changes are enough to reach ``least`` words. Runs that do not are not followed further.
    """
    numbers = np.asarray(doc, np.int32)
    runs = _exact_runs(item, numbers, diagonal)
    if not runs:
        return None
    best, first = None, item.least // 10 + 1
    words_ = numbers.tolist() if isinstance(doc, np.ndarray) else doc
    for start, end in runs:
        low, high = start, end
        while low and item.own[low - 1]:
            low -= 1
        while high < len(item.terms) and item.own[high]:
            high += 1
        for most in sorted({min(first, (high - low) // 10), (high - low) // 10}):
            left = _reach(item.terms, words_, start - 1, start - 1 + diagonal, -1, start - low, most)
            right = _reach(item.terms, words_, end, end + diagonal, 1, high - end, most)
            if max(left[a] + right[most - a] for a in range(most + 1)) + end - start < item.least:
                break
        else:
            for a, before in enumerate(left):
                for b, after in enumerate(right):
                    length = before + (end - start) + after
                    if length >= item.least and 10 * (a + b) <= length and (best is None or (length, -a - b) > (best[1], -best[2])):
                        best = (start - before, length, a + b)
    return best


def _agreeing(rows: pa.Table, look: Lookup) -> pa.Table:
    """``id, n, diagonal``: where two rare terms of a window of item ``n`` stand in a document as they do in the item."""
    rows = rows.combine_chunks()
    terms = rows["term"].to_pylist()
    ids = rows["ids"][terms.index(None)].as_py()
    docs, positions = (rows[c].chunk(0) for c in ("docs", "positions"))
    ends, docs, positions = docs.offsets.to_numpy(), docs.values.to_numpy(), positions.values.to_numpy()
    parts = []
    for k, term in enumerate(terms):
        if term is not None:
            doc, place = docs[ends[k] : ends[k + 1]], positions[ends[k] : ends[k + 1]]
            parts.extend((doc, np.full(len(doc), n, np.int32), place - np.int32(i), np.full(len(doc), i, np.int32)) for n, i in look.anchors[look.terms[term]])
    found = []
    if parts:
        doc, n, diagonal, at = (np.concatenate(c) for c in zip(*parts, strict=True))
        order = np.lexsort((diagonal, n, doc))
        doc, n, diagonal, at = doc[order], n[order], diagonal[order], at[order]
        same = (doc[1:] == doc[:-1]) & (n[1:] == n[:-1]) & (diagonal[1:] == diagonal[:-1])
        new = np.flatnonzero(np.r_[True, ~same])
        sizes = np.diff(np.r_[new, len(doc)])
        for s, size in zip(new[sizes > 1].tolist(), sizes[sizes > 1].tolist(), strict=True):
            places = set(at[s : s + size].tolist())
            if any(a in places and b in places for a, b in look.pairs[n[s]]):
                found.append((ids[doc[s]], int(n[s]), int(diagonal[s])))
    columns = list(zip(*found, strict=True)) or [[], [], []]
    return pa.table({name: pa.array(c, kind) for name, c, kind in zip(("id", "n", "diagonal"), columns, (pa.int64(), pa.int32(), pa.int32()), strict=True)})


def search_index(index: DataFrame, lookup: Lookup, documents: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id, item_id, first_word, n_words, n_changes, kind`` of each document and item it holds.

    The lengths of the lists of the evaluation terms choose the rare ones; their lists are read and
    intersected shard by shard, and the words of the documents that are left are compared.
    """
    spark = index.sparkSession
    known = spark.createDataFrame([(t,) for t in sorted(lookup.terms)] or [("",)], "term string")
    lengths = index.select("term", "n").join(F.broadcast(known), "term").groupBy("term").agg(F.sum("n").alias("n"))
    lookup.order_by_rarity({lookup.terms[r["term"]]: r["n"] for r in lengths.collect()})
    shared = spark.sparkContext.broadcast(lookup)
    rare = spark.createDataFrame([(t,) for t, code in sorted(lookup.terms.items()) if code in lookup.anchors] or [("",)], "term string")
    lists = index.select("shard", "term", "docs", "positions", "ids")
    read = lists.join(F.broadcast(rare), "term", "left_semi").unionByName(lists.filter("term IS NULL"))
    places = read.groupBy("shard").applyInArrow(lambda rows: _agreeing(rows, shared.value), "id long, n int, diagonal int")
    places = places.groupBy("id").agg(F.collect_set(F.struct("n", "diagonal")).alias("places"))
    names = [("id", pa.int64()), ("item_id", pa.int64()), ("first_word", pa.int32()), ("n_words", pa.int32()), ("n_changes", pa.int32()), ("kind", pa.string())]
    schema = pa.schema(names)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        look = shared.value
        for batch in batches:
            out: list[tuple] = []
            for doc, text, at in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                sequence = np.array([look.terms.get(w, -1) for w in words(text)], np.int32)
                candidates: dict[int, list[int]] = {}
                for place in at:
                    candidates.setdefault(place["n"], []).append(place["diagonal"])
                for n, diagonals in candidates.items():
                    item = look.items[n]
                    found = [s for d in sorted(diagonals) if (s := _stretch(item, sequence, d))]
                    if found:
                        first, length, changes = max(found, key=lambda s: (s[1], -s[2], -s[0]))
                        out.append((doc, item.item_id, first, length, changes, "proximity" if changes else "phrase"))
            columns = list(zip(*out, strict=True)) or [[] for _ in names]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    texts = documents.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    found = texts.join(places, "id").select("id", "text", "places").mapInArrow(compare, "id bigint, item_id bigint, first_word int, n_words int, n_changes int, kind string")
    return found.withColumnRenamed("id", id_col).distinct()


def find_leaks(
    documents: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", least_words: int = 14, least_cjk: int = 28
) -> DataFrame:
    """Documents that hold a passage of an evaluation item, with the longest stretch found.

    A passage is a stretch of ``least_words`` words in a row of the item (``least_cjk`` characters of
    Chinese) of which at most one in ten is changed, left out or added; writing does not matter (see
    :mod:`textnorm`), and stretches that stand word for word in several items do not count. The
    evaluation set is read by the driver and sent to the executors, and one of more than
    ``MOST_ITEM_CHARS`` characters raises; it goes in parts then. Null, empty and too short texts of either
    side give no rows; repeated rows give one row; other columns are ignored. Nothing but the lists of rare
    terms is shuffled, so a source that holds a third of all documents is spread as the files are.
    """
    chars = items.agg(F.sum(F.length(item_text_col)).alias("n")).first()["n"] or 0
    if chars > MOST_ITEM_CHARS:
        raise ValueError(f"evaluation items of {chars} characters, more than {MOST_ITEM_CHARS}")
    rows = items.select(F.col(item_col).cast("long"), F.col(item_text_col)).filter(F.col(item_col).isNotNull()).distinct().collect()
    lookup = read_items(sorted((tuple(r) for r in rows), key=lambda r: (r[0], r[1] or "")), least_words, least_cjk)
    staging = Staging(documents.sparkSession, "postings")
    index = staging.write(build_index(documents, id_col, text_col))
    return search_index(index, lookup, documents, id_col, text_col)
