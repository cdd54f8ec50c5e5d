"""Byte-level BPE of a whole corpus, merged by recursive SQL inside each partition.

Each partition holds a DuckDB session with the merge table. The distinct words of a chunk of texts
become rows (word, position, token); a recursive query joins neighbouring rows with the merge table
and contracts, in each word, the occurrences of its pair of minimum rank from left to right, until no
pair of any word has a merge. An ordered aggregate then gives each word's ids. Every round of that query
looks at the whole word, so an unbroken word of thousands of bytes (a line of base64, a protein) takes the
same contractions, in the same order, from a heap of its pairs instead.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values of the vocabulary: its word pattern, and the printable stand-ins of bytes.
WORD_PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PRINTABLE_BYTES = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]

ROUNDS_PER_CALL = 48
CHUNK_CHARS = 2_000_000
CACHE_WORDS = 400_000
LONG_WORD = 1_000  # bytes from which a word goes to the heap

MERGE_SQL = f"""
WITH RECURSIVE state(it, wid, pos, tok) AS (
  SELECT 0, wid, pos, tok FROM symbols
  UNION ALL
  SELECT it + 1, wid, pos, CASE WHEN take THEN made ELSE tok END
  FROM (
    SELECT *, coalesce(lag(take) OVER w, false) AS gone
    FROM (
      SELECT *, hit AND (n - max(CASE WHEN hit AND NOT before THEN n END) OVER (w ROWS UNBOUNDED PRECEDING)) % 2 = 0 AS take
      FROM (
        SELECT *, coalesce(lag(hit) OVER w, false) AS before, row_number() OVER w AS n
        FROM (
          SELECT *, coalesce(rank = min(rank) OVER (PARTITION BY wid), false) AS hit, min(rank) OVER (PARTITION BY wid) AS best
          FROM (
            SELECT p.*, m.rank, m.made
            FROM (SELECT *, lead(tok) OVER (PARTITION BY wid ORDER BY pos) AS nxt FROM state WHERE it < {ROUNDS_PER_CALL}) p
            LEFT JOIN merges m ON m.lft = p.tok AND m.rgt = p.nxt
          )
        ) WHERE best IS NOT NULL WINDOW w AS (PARTITION BY wid ORDER BY pos)
      ) WINDOW w AS (PARTITION BY wid ORDER BY pos)
    ) WINDOW w AS (PARTITION BY wid ORDER BY pos)
  ) WHERE NOT gone
)
SELECT wid, max(it) AS it, list(tok ORDER BY pos) AS ids
FROM (SELECT *, max(it) OVER (PARTITION BY wid) AS last FROM state) WHERE it = last GROUP BY wid
"""


@dataclass(frozen=True)
class Vocabulary:
    """``merges``: (left id, right id, rank, made id); ``byte_ids``: the id of each single byte."""

    merges: tuple[list[int], list[int], list[int], list[int]]
    byte_ids: list[int]
    token_bytes: dict[int, bytes]


def load_vocabulary(path: str) -> Vocabulary:
    """Read a byte-level BPE from a tokenizer's JSON file (vocab and merges); special tokens are left out."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    ids, merges = model["vocab"], model["merges"]
    shown = {b: chr(b) for b in PRINTABLE_BYTES}
    for b in range(256):
        shown.setdefault(b, chr(256 + sum(1 for c in range(b) if c not in PRINTABLE_BYTES)))
    hidden = {c: b for b, c in shown.items()}
    table: tuple[list[int], list[int], list[int], list[int]] = ([], [], [], [])
    for rank, pair in enumerate(merges):
        left, right = pair.split(" ") if isinstance(pair, str) else pair
        for column, value in zip(table, (ids[left], ids[right], rank, ids[left + right]), strict=True):
            column.append(value)
    token_bytes = {i: bytes(hidden[c] for c in t) for t, i in ids.items() if all(c in hidden for c in t)}
    return Vocabulary(table, [ids[shown[b]] for b in range(256)], token_bytes)


class Merger:
    """A DuckDB session with the merge table, and the words it has encoded."""

    def __init__(self, vocabulary: Vocabulary):
        import duckdb
        import numpy as np
        import regex

        self.np, self.words = np, regex.compile(WORD_PATTERN)
        self.byte_ids = np.array(vocabulary.byte_ids, dtype=np.int32)
        self.con = duckdb.connect(config={"threads": 1, "memory_limit": "400MB", "temp_directory": ""})
        merges = pa.table({n: pa.array(c, pa.int32()) for n, c in zip(("lft", "rgt", "rank", "made"), vocabulary.merges, strict=True)})
        self.con.register("given", merges)
        self.con.execute("CREATE TABLE merges AS SELECT * FROM given")
        self.con.unregister("given")
        self.merges, self.by_pair = vocabulary.merges, None
        self.known: dict[str, list[int]] = {}

    def _contract_long(self, tokens: list[int]) -> list[int]:
        """Final ids of one long word: its pairs by rank, then place; a pair that is no longer there is passed over."""
        if self.by_pair is None:
            self.by_pair = {(left, right): (rank, made) for left, right, rank, made in zip(*self.merges, strict=True)}
        find, n = self.by_pair.get, len(tokens)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(hit[0] << 40) | i for i in range(n - 1) if (hit := find((tokens[i], tokens[i + 1])))]
        heapq.heapify(heap)
        while heap:
            entry = heapq.heappop(heap)
            i = entry & ((1 << 40) - 1)
            j = after[i]
            if tokens[i] < 0 or j >= n:
                continue
            hit = find((tokens[i], tokens[j]))
            if hit is None or hit[0] != entry >> 40:
                continue
            tokens[i], tokens[j] = hit[1], -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if hit := find((tokens[i], tokens[k])):
                    heapq.heappush(heap, (hit[0] << 40) | i)
            if (h := before[i]) >= 0 and (hit := find((tokens[h], tokens[i]))):
                heapq.heappush(heap, (hit[0] << 40) | h)
        return [t for t in tokens if t >= 0]

    def _contract(self, sizes, tokens) -> list[list[int]]:
        """Final ids of words given as runs of tokens; a word with more merges than a call allows goes on in the next."""
        np = self.np
        out: list[list[int] | None] = [None] * len(sizes)
        wids = np.arange(len(sizes), dtype=np.int32)
        while len(wids):
            starts = np.cumsum(sizes) - sizes
            pos = np.arange(len(tokens), dtype=np.int64) - np.repeat(starts, sizes)
            symbols = pa.table({"wid": np.repeat(wids, sizes), "pos": pos.astype(np.int32), "tok": tokens})
            self.con.register("symbols", symbols)
            rows = self.con.execute(MERGE_SQL).fetchall()
            self.con.unregister("symbols")
            rest = []
            for wid, it, ids in rows:
                if it < ROUNDS_PER_CALL:
                    out[wid] = ids
                else:
                    rest.append((wid, ids))
            wids = np.array([w for w, _ in rest], dtype=np.int32)
            sizes = np.array([len(i) for _, i in rest], dtype=np.int64)
            tokens = np.array([t for _, i in rest for t in i], dtype=np.int32)
        return out

    def encode(self, texts: list[str | None]) -> list[list[int]]:
        split = [self.words.findall(t) if t else [] for t in texts]
        fresh = list({w for ws in split for w in ws if w not in self.known})
        if len(self.known) > CACHE_WORDS:
            self.known = {w: self.known[w] for ws in split for w in ws if w in self.known}
        for word in [w for w in fresh if len(w) * 4 >= LONG_WORD]:
            raw = word.encode("utf-8", "surrogatepass")
            if len(raw) >= LONG_WORD:
                self.known[word] = self._contract_long(self.byte_ids[self.np.frombuffer(raw, dtype=self.np.uint8)].tolist())
        fresh = [w for w in fresh if w not in self.known]
        at = 0
        while at < len(fresh):
            raw, total = [], 0
            while at < len(fresh) and (not raw or total < 150_000):
                raw.append(fresh[at].encode("utf-8", "surrogatepass"))
                total += len(raw[-1])
                at += 1
            sizes = self.np.array([len(r) for r in raw], dtype=self.np.int64)
            tokens = self.byte_ids[self.np.frombuffer(b"".join(raw), dtype=self.np.uint8)]
            for word, ids in zip(fresh[at - len(raw) : at], self._contract(sizes, tokens), strict=True):
                self.known[word] = ids
        return [[i for w in ws for i in self.known[w]] for ws in split]


def encode_corpus(df: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, ids``: the token ids of every text; null and empty texts give an empty list.

    A string that looks like a special token is ordinary text; blank texts are encoded as they are; a
    null id stays null, repeated rows are kept. One narrow pass: no shuffle, each partition encodes each
    distinct word once (up to the size of its cache) and texts are taken in chunks of bounded length,
    so memory does not grow with the partition, only with the longest text. The merge table (50,000 rows) travels in the closure.
    """
    vocabulary = df.sparkSession.sparkContext.broadcast(load_vocabulary(vocabulary_path))
    schema = pa.schema([("id", pa.int64()), ("ids", pa.list_(pa.int32()))])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merger = Merger(vocabulary.value)
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            begin = 0
            while begin < len(texts):
                end, chars = begin, 0
                while end < len(texts) and (end == begin or chars + len(texts[end] or "") <= CHUNK_CHARS):
                    chars += len(texts[end] or "")
                    end += 1
                out = merger.encode(texts[begin:end])
                yield pa.RecordBatch.from_arrays([ids.slice(begin, end - begin), pa.array(out, pa.list_(pa.int32()))], schema=schema)
                begin = end

    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(encode, "id bigint, ids array<int>").select(F.col("id").alias(id_col), "ids")


def decode_corpus(df: DataFrame, vocabulary_path: str, id_col: str = "doc_id") -> DataFrame:
    """``id, text`` of rows with token ids; null ids give a null text, bytes that are no UTF-8 become U+FFFD."""
    token_bytes = df.sparkSession.sparkContext.broadcast(load_vocabulary(vocabulary_path).token_bytes)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb

        con = duckdb.connect(config={"threads": 1, "memory_limit": "400MB", "temp_directory": ""})
        con.register("given", pa.table({"tok": pa.array(list(token_bytes.value), pa.int32()), "hex": [b.hex() for b in token_bytes.value.values()]}))
        con.execute("CREATE TABLE vocabulary AS SELECT * FROM given")
        for batch in batches:
            rows = pa.table({"n": pa.array(range(batch.num_rows), pa.int64()), "ids": batch.column(1)})
            con.register("corpus", rows)
            got = con.execute(
                "SELECT n, string_agg(hex, '' ORDER BY pos) FROM (SELECT n, unnest(ids) AS tok, generate_subscripts(ids, 1) AS pos FROM corpus) JOIN vocabulary USING (tok) GROUP BY n"
            ).fetchall()
            con.unregister("corpus")
            texts = [None if v is None else "" for v in batch.column(1).to_pylist()]
            for n, hexed in got:
                texts[n] = bytes.fromhex(hexed).decode("utf-8", "replace")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["id", "text"])

    return df.select(F.col(id_col).cast("long").alias("id"), "ids").mapInArrow(decode, "id bigint, text string").select(F.col("id").alias(id_col), "text")
