"""Evaluation passages in training text (problem 8), by greedy string tiling.

Both sides become token numbers.  Runs of ``SEED`` tokens are hashed by Karp-Rabin
rolling hashes and joined; every hit is run out along its diagonal to the longest
match.  Matches are marked longest first (the tiles); what a mark leaves free of a
match goes back into the queue.  Tiles that follow each other with little between
them form a passage.  A document holds an item if a passage covers enough of it in
order, or if long tiles in whatever order cover a good part of the whole item.

The items are a stated query set.  If they are few enough to be sent to all tasks,
nothing is shuffled; else seeds are joined by their hashes and only the documents
that share enough seeds with an item go on.  Either way the texts are scanned once.
"""

from __future__ import annotations

import functools
import re
import unicodedata
from collections import defaultdict
from heapq import heapify, heappop, heappush
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.session import cut

SEED = 4
#: Tokens of an item that a passage must span: words, or characters of Chinese.
WORDS, CHARACTERS = 12, 20
#: At most one token in so many may be changed.
ONE_IN = 8
#: Tokens that may stand between two tiles of one passage.
GAP = 3
#: Coverage: tokens of a tile that counts, and the share of an item that such tiles must cover in any order.
LONG_TILE, COVERAGE = 5, 0.5
#: Tokens of all items that are sent to all tasks; beyond, seeds are joined.
SENT_TOKENS = 2_000_000
#: Bits of the filter through which seeds of documents go before they are joined.
FILTER_BITS = 1 << 28
_MARKS = re.compile(r"<(su[pb])>[^<]{0,40}</\1>|\[\s*\d+(?:\s*[,;–-]\s*\d+)*\s*\]|\(\s*\d+(?:\s*[,;–-]\s*\d+)*\s*\)|[⁰¹²³⁴-⁹]+|[​‌‍⁠﻿­]")
_TOKEN = re.compile(r"[぀-ヿ一-鿿]|[^\W\d_぀-ヿ一-鿿]+|\d+")
_HAN = re.compile(r"[぀-ヿ一-鿿]")
_BASE = np.int64(1_000_003)


def tokens(text: str) -> list[str]:
    """Words in lower case, single Chinese characters, numbers; without reference marks and punctuation."""
    return _TOKEN.findall(_MARKS.sub("", unicodedata.normalize("NFC", text)).casefold())


def _hashes(ids: np.ndarray) -> np.ndarray:
    """Rolling hash of each run of ``SEED`` tokens."""
    n = len(ids) - SEED + 1
    if n <= 0:
        return np.empty(0, dtype="int64")
    with np.errstate(over="ignore"):
        h = np.zeros(n, dtype="int64")
        for k in range(SEED):
            h = h * _BASE + ids[k : k + n]
    return h


@functools.lru_cache(maxsize=200_000)
def _code(word: str) -> int:
    return xxhash.xxh64_intdigest(word) - (1 << 63)


def coded(text: str) -> tuple[np.ndarray, int]:
    """The tokens of a text as numbers that are the same everywhere, and the tokens that a passage of it must span."""
    words = tokens(text)
    han = sum(bool(_HAN.match(w)) for w in words)
    return np.fromiter((_code(w) for w in words), dtype="int64", count=len(words)), CHARACTERS if 2 * han > len(words) else WORDS


def tiles_of(doc: np.ndarray, item: np.ndarray, diagonals: dict[int, list[int]]) -> list[tuple[int, int, int]]:
    """Non-overlapping longest matches (document position, item position, length), in document order.

    The longest unmarked match is marked first; a match that has been marked in
    part comes back as its free stretches.
    """
    queue = []
    for d in diagonals:
        lo, hi = max(0, d), min(len(doc), d + len(item))
        same = doc[lo:hi] == item[lo - d : hi - d]
        edge = np.flatnonzero(np.diff(np.concatenate(([0], same.view("int8"), [0]))))
        queue += [(-int(b - a), lo + int(a), lo + int(a) - d) for a, b in edge.reshape(-1, 2)]
    heapify(queue)
    in_doc, in_item, tiles = np.zeros(len(doc), bool), np.zeros(len(item), bool), []
    while queue:
        n, p, q = heappop(queue)
        n = -n
        free = ~(in_doc[p : p + n] | in_item[q : q + n])
        if free.all():
            in_doc[p : p + n] = in_item[q : q + n] = True
            tiles.append((p, q, n))
        elif free.any():
            edge = np.flatnonzero(np.diff(np.concatenate(([0], free.view("int8"), [0]))))
            for a, b in edge.reshape(-1, 2).tolist():
                heappush(queue, (a - b, p + a, q + a))
    return sorted(tiles)


def held(doc: np.ndarray, item: np.ndarray, least: int, hits: list[tuple[int, int]]) -> tuple[int, int] | None:
    """Tokens of the longest passage of an item in a document (0 if none is long enough) and tokens that long tiles cover; null if neither is enough.

    ``hits``: (diagonal, document position) of shared seeds.
    """
    diagonals = defaultdict(list)
    for diagonal, pos in hits:
        diagonals[diagonal].append(pos)
    # Fewer hits on a single diagonal can't make a passage, whatever tokens of it are changed.
    if len(diagonals) < 2 and len(hits) < least_hits(least):
        return None
    tiles = tiles_of(doc, item, diagonals)
    span = longest_passage(tiles, least, doc, item)
    covered = sum(n for _, _, n in tiles if n >= LONG_TILE)
    return (span, covered) if span or covered >= max(least, COVERAGE * len(item)) else None


class Items:
    """Items with their seeds in order of hash, ready to be looked up."""

    def __init__(self, rows: list[tuple[int, str]]):
        self.ids, self.tokens, self.least = [], [], []
        hashes, owner, at = [], [], []
        for item_id, text in rows:
            codes, least = coded(text or "")
            h = _hashes(codes)
            hashes.append(h)
            owner.append(np.full(len(h), len(self.ids), dtype="int64"))
            at.append(np.arange(len(h), dtype="int64"))
            self.ids.append(item_id)
            self.tokens.append(codes)
            self.least.append(least)
        join = lambda x: np.concatenate(x) if x else np.empty(0, dtype="int64")
        order = np.argsort(join(hashes), kind="stable")
        self.seed, self.item, self.at = join(hashes)[order], join(owner)[order], join(at)[order]

    def passages(self, text: str) -> list[tuple[int, int, int]]:
        """(item id, tokens of the longest passage, tokens covered by long tiles) of the items that the text holds."""
        doc, _ = coded(text)
        h = _hashes(doc)
        first = np.searchsorted(self.seed, h, "left")
        last = np.searchsorted(self.seed, h, "right")
        hits = np.nonzero(last > first)[0]
        by_item: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for pos in hits.tolist():
            for s in range(first[pos], last[pos]):
                by_item[int(self.item[s])].append((pos - int(self.at[s]), pos))
        out = []
        for i, found in by_item.items():
            found_ = held(doc, self.tokens[i], self.least[i], found)
            if found_:
                out.append((self.ids[i], *found_))
        return out


def least_hits(least: int) -> int:
    """Seed hits that a passage on one diagonal has at least: a changed token takes ``SEED`` of them; a span of ``ONE_IN`` more never has fewer."""
    return min(n - SEED + 1 - SEED * (n // ONE_IN) for n in range(least, least + ONE_IN))


def longest_passage(tiles: list[tuple[int, int, int]], least: int, doc: np.ndarray, item: np.ndarray) -> int:
    """Tokens of the item in its longest passage: tiles in order with few changes; 0 if none is long enough.

    A passage begins and ends with a tile of two tokens or more; single tokens
    count only between such tiles, as they match by chance.
    """
    best = 0
    for a in range(len(tiles)):
        p, q, n = tiles[a]
        if n < 2:
            continue
        span, changed = n, 0
        for b in range(a, len(tiles)):
            if b > a:
                gap_doc, gap_item = tiles[b][0] - p - n, tiles[b][1] - q - n
                if not (0 <= gap_doc <= GAP and 0 <= gap_item <= GAP):
                    continue
                p, q, n = tiles[b]
                span, changed = span + gap_item + n, changed + max(gap_doc, gap_item)
            if n > 1 and span >= least and changed * ONE_IN <= span:
                best = max(best, span)
    return best


_FOUND = "doc_id bigint, item_id bigint, passage int, covered int"


def _by_broadcast(documents: DataFrame, listed: list[tuple[int, str]]) -> DataFrame:
    block = documents.sparkSession.sparkContext.broadcast(Items(listed))

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(d, *hit) for d, t in zip(batch["doc_id"], batch["text"], strict=True) for hit in block.value.passages(t)]
            if rows:
                yield pd.DataFrame(rows, columns=["doc_id", "item_id", "passage", "covered"])

    return documents.mapInPandas(search, _FOUND)


def _seeds(texts: DataFrame, key: str, bits=None) -> DataFrame:
    """Distinct seeds of each text: key, h; given a filter, only those that pass it."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for k, t in zip(b[key], b["text"], strict=True):
                h = np.unique(_hashes(coded(t)[0]))
                if bits is not None:
                    spot = h.view("uint64") % np.uint64(FILTER_BITS)
                    h = h[(bits.value[spot >> np.uint64(3)] >> (spot & np.uint64(7)).astype("uint8")) & 1 == 1]
                if len(h):
                    yield pd.DataFrame({key: k, "h": h})

    return texts.select(key, "text").mapInPandas(run, f"{key} bigint, h bigint")


def _by_join(documents: DataFrame, items: DataFrame) -> DataFrame:
    """Candidates by equal seeds, then tiles of those pairs only; nothing grows with the number of items but the joins."""
    spark = documents.sparkSession
    seeds = cut(_seeds(items, "item_id"))

    def spots(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            spot = b["h"].to_numpy("int64").view("uint64") % np.uint64(FILTER_BITS)
            yield pd.DataFrame({"byte": (spot >> np.uint64(3)).astype("int64"), "bit": (np.uint64(1) << (spot & np.uint64(7))).astype("int64")})

    bits = np.zeros(FILTER_BITS // 8, dtype="uint8")
    for r in seeds.mapInPandas(spots, "byte bigint, bit bigint").groupBy("byte").agg(F.bit_or("bit").alias("bit")).toLocalIterator():
        bits[r["byte"]] = r["bit"]
    pairs = _seeds(documents, "doc_id", spark.sparkContext.broadcast(bits)).join(seeds, "h").select("doc_id", "item_id").distinct()
    both = pairs.join(documents, "doc_id").join(items.select("item_id", F.col("text").alias("item")), "item_id").select("doc_id", "item_id", "text", "item")

    def tile(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(d, *hit) for d, i, t, x in b.itertuples(index=False, name=None) for hit in Items([(i, x)]).passages(t)]
            if rows:
                yield pd.DataFrame(rows, columns=["doc_id", "item_id", "passage", "covered"])

    return both.mapInPandas(tile, _FOUND)


def leaks(documents: DataFrame, items: DataFrame) -> DataFrame:
    """Documents that hold an item: doc_id, item_id, passage (tokens in order; 0 if the item comes only in other order), covered (tokens in long tiles).

    ``documents``: doc_id, text; ``items``: item_id, text.  Null or empty texts
    hold nothing; repeated rows come out once each; texts of any length are read
    whole; other columns are ignored.
    """
    docs = documents.select("doc_id", "text").where(F.length("text") > 0)
    asked = items.select("item_id", "text").where(F.length("text") > 0)
    if (asked.agg(F.sum(F.length("text"))).first()[0] or 0) <= SENT_TOKENS:
        return _by_broadcast(docs, [(r["item_id"], r["text"]) for r in asked.orderBy("item_id").collect()])
    return _by_join(docs.dropDuplicates(), asked)


def leaked_items(found: DataFrame, items: DataFrame) -> DataFrame:
    """Every item with the number of documents that hold a passage of it, that hold it in other order only, and the longest passage: item_id, n_documents, n_reordered, longest."""
    each = found.groupBy("item_id", "doc_id").agg(F.max("passage").alias("passage"))
    per = each.groupBy("item_id").agg(F.count_if(F.col("passage") > 0).alias("n_documents"), F.count_if(F.col("passage") == 0).alias("n_reordered"), F.max("passage").alias("longest"))
    return items.select("item_id").distinct().join(per, "item_id", "left").fillna(0, ["n_documents", "n_reordered", "longest"])
