"""Benchmark decontamination by spaced-seed hashing.

Documents and benchmark items are sequences of lower-cased words. A few fixed masks look at five words of a window and ignore those
between; equal hashes under a mask, at a document's and an item's place, are a hit. Each hit fixes how the two are aligned; along that diagonal a
window of WINDOW words (the whole item, if shorter) must have 80 per cent of its words equal. Whichever words of such a window are replaced by others, one of the
masks hits (tests try all choices): three masks of five words do for whole windows, items shorter than one have four masks of four words. So the search loses no overlap of this kind.

The benchmark is cut into blocks of a bounded number of items, each of which is sent to the executors in turn; documents are read whole, where they lie.

Defined cases: null texts are empty; items of fewer than five words match nothing, since such words stand in clean documents too; places before or after a document's words count as
unequal; very long texts are hashed CHUNK words' worth of documents at a time, the longest one whole, and hits are looked at HITS at a time; a null item_id is kept as null;
repeated documents or items give repeated results, one row per document and item; other columns are left alone; empty tables give no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gyeol.llm.common import in_batches

MASKS = ["11111", "111011", "1101011"]
#: For items that are shorter than a window.
SHORT_MASKS = ["1111", "11011", "10111", "11101"]
#: Seed hits that are looked at together.
HITS = 500_000
LEAST_WORDS = 5
WINDOW = 13
#: Words of benchmark that are sent to the executors at once.
BLOCK_WORDS = 2_000_000
WORD = re.compile(r"\w+")
#: Words of documents that are hashed at once.
CHUNK = 400_000
BITS = 22


def words(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


class Seeds:
    """The hashes of a block of items under each mask."""

    def __init__(self, items: list[tuple[int | None, list[str]]]) -> None:
        self.items = [i for i, w in items if len(w) >= LEAST_WORDS]
        texts = [w for _, w in items if len(w) >= LEAST_WORDS]
        self.vocab = {w: k + 1 for k, w in enumerate(dict.fromkeys(x for t in texts for x in t))}
        self.texts = [np.array([self.vocab[x] for x in t], dtype=np.uint64) for t in texts]
        self.gap = max(map(len, MASKS + SHORT_MASKS))
        short = [k for k, t in enumerate(self.texts) if len(t) < WINDOW]
        whole = [k for k, t in enumerate(self.texts) if len(t) >= WINDOW]
        self.tables = [(m, *self.table(m, of)) for masks, of in ((MASKS, whole), (SHORT_MASKS, short)) if of for m in masks]

    def table(self, mask: str, of: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Which first bits of hashes there are; the hashes of the items numbered in of, sorted; their items; their places."""
        gap = np.zeros(self.gap, dtype=np.uint64)
        flat = np.concatenate([x for k in of for x in (self.texts[k], gap)])
        size = [len(self.texts[k]) + self.gap for k in of]
        owner, start = np.repeat(of, size), np.concatenate([np.arange(n) for n in size])
        h, ok = hashes(flat, mask)
        at = np.flatnonzero(ok)
        order = at[np.argsort(h[at], kind="stable")]
        bits = np.zeros(1 << BITS, dtype=bool)
        bits[h[order] >> np.uint64(64 - BITS)] = True
        return bits, h[order], owner[order], start[order]

    def hits(self, flat: np.ndarray, begin: np.ndarray) -> Iterator[np.ndarray]:
        """Rows of (item, diagonal, document), HITS or so at a time; a passage that many items share gives one for each of them."""
        for mask, bits, keys, owner, start in self.tables:
            h, ok = hashes(flat, mask)
            ok &= bits[h >> np.uint64(64 - BITS)]
            at = np.flatnonzero(ok)
            lo, hi = np.searchsorted(keys, h[at], "left"), np.searchsorted(keys, h[at], "right")
            some = hi > lo
            at, lo, n = at[some], lo[some], (hi - lo)[some]
            ends = np.cumsum(n)
            cut = [0, *(np.searchsorted(ends, np.arange(HITS, int(ends[-1]), HITS)) + 1).tolist(), len(at)] if len(at) else []
            for a, b in zip(cut, cut[1:], strict=False):
                if a < b:
                    m, first = n[a:b], lo[a:b]
                    src = np.repeat(first, m) + np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
                    pos = np.repeat(at[a:b], m)
                    yield np.unique(np.stack([owner[src], pos - start[src], np.searchsorted(begin, pos, "right") - 1], 1), axis=0)

    def find(self, docs: list[list[str]]) -> list[tuple[int, int, int, int, int]]:
        """(document, item, first word of the best window, words of it, equal ones), one per document and item."""
        if not self.items:
            return []
        get = self.vocab.get
        ids = [np.array([get(w, 0) for w in d], dtype=np.uint64) for d in docs]
        begin = np.cumsum([0] + [len(d) + self.gap for d in ids])
        flat = np.zeros(int(begin[-1]) + self.gap, dtype=np.uint64)
        for b, d in zip(begin, ids, strict=False):
            flat[b : b + len(d)] = d
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        done: set[tuple[int, int, int]] = set()
        for rows in self.hits(flat, begin):
            for k, diagonal, d in map(tuple, rows.tolist()):
                if (k, diagonal, d) in done:
                    continue
                done.add((k, diagonal, d))
                t = self.texts[k]
                lo, hi = max(0, int(begin[d]) - diagonal), min(len(t), int(begin[d]) + len(ids[d]) - diagonal)
                equal = np.zeros(len(t), dtype=np.int64)
                equal[lo:hi] = flat[diagonal + lo : diagonal + hi] == t[lo:hi]
                size = min(len(t), WINDOW)
                same = np.concatenate([[0], np.cumsum(equal)])
                runs = same[size:] - same[:-size]
                j = int(runs.argmax())
                if 5 * runs[j] >= 4 * size:
                    now = (int(same[-1]), -max(0, int(diagonal + j - begin[d])), int(runs[j]))
                    best[d, k] = max(best.get((d, k), now), now)
        return [(d, k, -s, min(len(self.texts[k]), WINDOW), r) for (d, k), (_, s, r) in sorted(best.items())]


def hashes(ids: np.ndarray, mask: str) -> tuple[np.ndarray, np.ndarray]:
    """Of each place: the hash of the words that the mask looks at, and whether all of them are known."""
    n = max(len(ids) - len(mask) + 1, 0)
    h, ok = np.zeros(n, dtype=np.uint64), np.ones(n, dtype=bool)
    known = ids != 0
    for i, c in enumerate(mask):
        if c == "1":
            h = (h + ids[i : i + n]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
            ok &= known[i : i + n]
    return h * np.uint64(0xBF58476D1CE4E5B9), ok


def chunks(texts: list[str | None]) -> Iterator[tuple[int, list[list[str]]]]:
    """(number of the first, words of each) for consecutive texts of about CHUNK words."""
    first, out, n = 0, [], 0
    for k, t in enumerate(texts):
        out.append(words(t))
        n += len(out[-1])
        if n >= CHUNK:
            yield first, out
            first, out, n = k + 1, [], 0
    if out:
        yield first, out


def blocks(benchmark: DataFrame) -> Iterator[Seeds]:
    """The items in blocks of about BLOCK_WORDS words; a block is what is sent to the executors at once."""
    items = benchmark.select("item_id", "text")
    total = items.agg(F.sum(F.char_length("text"))).first()[0] or 0
    n = int(total // (4 * BLOCK_WORDS)) + 1
    for k in range(n):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k) if n > 1 else items
        yield Seeds([(r.item_id, words(r.text)) for r in part.orderBy("item_id", "text").collect()])


def overlaps(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, first_word, n_words, n_equal: the documents that hold a passage of an item."""
    parts = []
    for seeds in blocks(benchmark):
        shared = docs.sparkSession.sparkContext.broadcast(seeds)

        def rows(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
            for b in batches:
                ids, out = b["doc_id"].to_pylist(), []
                for first, docs_ in chunks(b["text"].to_pylist()):
                    out += [(ids[first + d], shared.value.items[k], s, n, r) for d, k, s, n, r in shared.value.find(docs_)]
                names = ["doc_id", "item_id", "first_word", "n_words", "n_equal"]
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in range(5)], names)

        parts.append(in_batches(docs.select(F.col("doc_id").cast("long"), "text")).mapInArrow(rows, "doc_id long, item_id long, first_word long, n_words long, n_equal long"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without those that hold a passage of an item."""
    for seeds in blocks(benchmark):
        shared = docs.sparkSession.sparkContext.broadcast(seeds)

        def rows(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
            for b in batches:
                bad = {first + d for first, docs_ in chunks(b["text"].to_pylist()) for d, *_ in shared.value.find(docs_)}
                yield b.filter(pa.array([k not in bad for k in range(b.num_rows)], pa.bool_()))

        docs = in_batches(docs).mapInArrow(rows, docs.schema)
    return docs
