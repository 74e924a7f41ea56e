"""Removal of repeated passages by suffix arrays in a logarithmic family of levels.

Every byte that lies in a LENGTH-byte string which also starts elsewhere (in any document, the same one included) is removed. A string of
LENGTH bytes holds at least one anchor: a place whose GRAM-byte hash is the least of a window. Equal strings have their anchors at equal offsets, so only suffixes at
anchors are sorted, and only at anchors whose gram occurs at least twice; a bitmap of fixed size tells which.

Around such an anchor a document sends LENGTH bytes to the right and LENGTH - GRAM to the left, equal contexts of a task once, to the place
of the gram. There contexts arrive in batches. A batch gets two suffix arrays, of what follows the anchor and of what precedes it, read backwards; it is merge-scanned against
the existing levels for long matches, which are shares of both arrays that agree on LENGTH bytes together; levels of equal rank merge, so a context takes part in a logarithmic number of merges.
A gram of more than HUGE anchors is never in one place: there each window's digest is counted instead, folded per task.

Beside that, passages of PASSAGE words that stand in another document too are told of (column repeats), though many are shorter than LENGTH bytes. Each window of PASSAGE
words goes to the place of its least gram of PASSAGE_GRAM words, as a hash, if that gram is in two documents at least. Two windows are equal by 96 bits of hashes.

Defined cases: null texts are empty; texts under LENGTH bytes keep everything; repeated rows are repetitions of one another; rows of one doc_id
that differ are documents of their own; spans that touch are one; other columns are left alone; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gyeol.llm.common import durable, in_batches, once

LENGTH, GRAM = 400, 64
REACH = LENGTH - GRAM
WINDOW = REACH + 1
SLOTS = 1 << 27
BATCH = 2_048
HUGE = 100_000
#: Rows that a task sends at once.
ROWS = 4_000
#: Contexts that a task remembers having sent; beyond it, it starts again.
SENT = 200_000
#: Ids that may be sent to every executor; beyond it, texts are shuffled to them.
BROADCAST_IDS = 1_000_000
BASE, INVERSE = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)
CHUNK = 1 << 18
#: Words of a passage that is told of where it stands in another document too, and of the grams that bring equal passages together.
PASSAGE, PASSAGE_GRAM = 51, 8
SPACE = re.compile(rb"[\x20\x09-\x0D]")


def _sliding(x: np.ndarray, n: int, of) -> np.ndarray:  # noqa: ANN001
    """of (np.minimum or np.maximum) over each n consecutive values."""
    k = 1
    while 2 * k <= n:
        x = of(x[:-k], x[k:])
        k *= 2
    return of(x[: len(x) - (n - k)], x[n - k :]) if n > k else x


def _mixed(g: np.ndarray) -> np.ndarray:
    g ^= g >> np.uint64(31)
    g *= np.uint64(0xBF58476D1CE4E5B9)
    g ^= g >> np.uint64(29)
    return g


class Anchors:
    """The anchors of byte strings: places and signed 64-bit hashes of their grams."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def _powers(self, n: int) -> None:
        if len(self.up) < n:
            with np.errstate(over="ignore"):
                self.up = np.concatenate([[np.uint64(1)], np.cumprod(np.full(n, BASE, dtype=np.uint64))])
                self.down = np.concatenate([[np.uint64(1)], np.cumprod(np.full(n, INVERSE, dtype=np.uint64))])

    def of(self, data: bytes) -> tuple[np.ndarray, np.ndarray]:
        """One document in pieces that overlap by a window, so memory doesn't grow with it."""
        step, places, grams = CHUNK, [], []
        for a in range(0, max(len(data) - LENGTH + 1, 0), step):
            p, h = self._piece(np.frombuffer(data, dtype=np.uint8, count=min(step + LENGTH - 1, len(data) - a), offset=a))
            places.append(p + a)
            grams.append(h)
        if not places:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        p, first = np.unique(np.concatenate(places), return_index=True)
        return p, np.concatenate(grams)[first]

    def words(self, data: bytes) -> np.ndarray:
        """A 64-bit hash of each word (bytes other than white space) of a text, in pieces that end at white space."""
        out, at = [], 0
        while at < len(data):
            c = np.frombuffer(data, dtype=np.uint8, count=min(CHUNK, len(data) - at), offset=at)
            ink = np.concatenate([[False], (c > 32) | (c < 9) | ((c > 13) & (c < 32)), [False]])
            if at + len(c) < len(data) and ink[-2]:
                gaps = np.flatnonzero(~ink[1:-1])
                if len(gaps):
                    c = c[: gaps[-1] + 1]
                else:  # one word longer than a piece
                    m = SPACE.search(data, at)
                    c = np.frombuffer(data, dtype=np.uint8, count=(m.start() if m else len(data)) - at, offset=at)
                    ink = np.concatenate([[False], np.ones(len(c), dtype=bool), [False]])
                ink = np.concatenate([ink[: len(c) + 1], [False]])
            edge = np.flatnonzero(ink[1:] != ink[:-1])
            a, e = edge[::2], edge[1::2]
            self._powers(len(c) + 1)
            s = np.zeros(len(c) + 1, dtype=np.uint64)
            np.cumsum((c.astype(np.uint64) + np.uint64(1)) * self.up[: len(c)], out=s[1:])
            out.append(_mixed((s[e] - s[a]) * self.down[a] + (e - a).astype(np.uint64)))
            at += len(c)
        return np.concatenate(out) if out else np.zeros(0, dtype=np.uint64)

    def passages(self, data: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Of each window of PASSAGE words: its least gram (signed 64 bits) and a hash of its own (32 bits)."""
        w = self.words(data)
        if len(w) < PASSAGE:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int32)
        self._powers(len(w) + 1)
        s = np.zeros(len(w) + 1, dtype=np.uint64)
        np.cumsum(w * self.up[: len(w)], out=s[1:])
        of = lambda n: _mixed((s[n:] - s[:-n]) * self.down[: len(w) - n + 1])
        low = _sliding(of(PASSAGE_GRAM), PASSAGE - PASSAGE_GRAM + 1, np.minimum)
        return low.view(np.int64), (of(PASSAGE) >> np.uint64(32)).astype(np.uint32).view(np.int32)

    def _piece(self, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = len(c)
        self._powers(n + 1)
        s = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum((c.astype(np.uint64) + np.uint64(1)) * self.up[:n], out=s[1:])
        g = _mixed((s[GRAM:] - s[:-GRAM]) * self.down[: n - GRAM + 1])
        low = _sliding(g, WINDOW, np.minimum)
        pad = np.zeros(WINDOW - 1, dtype=np.uint64)
        most = _sliding(np.concatenate([pad, low, pad]), WINDOW, np.maximum)
        at = np.flatnonzero(most == g)
        return at, g[at].view(np.int64)


def _bytes(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    col = batch[name]
    return [b"" if x is None else x for x in col.cast(pa.binary() if pa.types.is_string(col.type) else pa.large_binary()).to_pylist()]


def gram_counts(docs: DataFrame) -> DataFrame:
    """h, n: how many anchors each gram has, and of grams of words how many documents have it as an anchor; summed per batch first."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = once(("anchors",), Anchors)
        for b in batches:
            found = []
            for i in range(b.num_rows):
                x = _bytes(b.slice(i, 1))[0]
                if len(x) >= LENGTH:
                    found.append(anchors.of(x)[1])
                if len(x) >= 2 * PASSAGE - 1:
                    found.append(np.unique(anchors.passages(x)[0]))
            h, n = np.unique(np.concatenate(found), return_counts=True) if found else (np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(n.astype(np.int64))], ["h", "n"])

    return in_batches(docs.select("text")).mapInArrow(rows, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))


def bitmap(counts: DataFrame) -> np.ndarray:
    """One bit for each slot of a gram that occurs twice at least: SLOTS bits whatever the input."""
    slot = counts.where("n > 1").select(F.pmod("h", F.lit(SLOTS)).alias("s"))
    rows = slot.groupBy(F.floor(F.col("s") / 32768).cast("long").alias("b")).agg(F.expr("bitmap_construct_agg(s % 32768)").alias("m")).collect()
    out = np.zeros(SLOTS // 8, dtype=np.uint8)
    for r in rows:
        out[r.b * 4096 : (r.b + 1) * 4096] = np.frombuffer(r.m, dtype=np.uint8)
    return out


def _known(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    s = h % SLOTS
    return (bits[s >> 3] >> (s & 7).astype(np.uint8)) & 1 == 1


def _digest(left: bytes, right: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(left + right, digest_size=8, key=len(left).to_bytes(2, "little")).digest(), "little", signed=True)


def occurrences(docs: DataFrame, bits, huge: set[int], what: str) -> DataFrame:  # noqa: ANN001
    """The anchors whose gram is in the bitmap. what: 'places' (h, cd, doc_id, d, at), 'contexts' (h, cd, left, right, n; a context's bytes once per task, with
    how often, the bytes null where the task has sent them before), or 'windows' of the huge grams (doc_id, d, start, w: a digest of LENGTH bytes)."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors, big = once(("anchors",), Anchors), np.array(sorted(huge), dtype=np.int64)
        again: dict[tuple[int, int], int] = {}  # contexts that this task has sent, and how often they came again
        out: list[tuple] = []

        def batch() -> pa.RecordBatch:
            cols = list(zip(*out, strict=True)) if out else [[] for _ in schema]
            made = pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(cols, schema, strict=True)], [k for k, _ in schema])
            out.clear()
            return made

        def told() -> Iterator[pa.RecordBatch]:
            """How often the contexts that were sent came again; they are forgotten then."""
            for (g, cd), n in again.items():
                if n:
                    out.append((g, cd, None, None, n))
                    if len(out) >= ROWS:
                        yield batch()
            again.clear()

        for b in batches:
            for i in range(b.num_rows):
                one = b.slice(i, 1)
                x = _bytes(one)[0]
                if len(x) < LENGTH:
                    continue
                doc, d = one["doc_id"][0].as_py(), one["d"][0].as_py()
                at, h = anchors.of(x)
                ok = _known(bits.value, h)
                in_big = np.isin(h, big) if len(big) else np.zeros(len(h), dtype=bool)
                ok &= in_big if what == "windows" else ~in_big
                if what == "windows":  # a window once, however many of these anchors it holds
                    for s in sorted({s for p in at[ok].tolist() for s in range(max(0, p - REACH), min(p, len(x) - LENGTH) + 1)}):
                        out.append((doc, d, s, hashlib.blake2b(x[s : s + LENGTH], digest_size=16).digest()))
                        if len(out) >= ROWS:
                            yield batch()
                    continue
                for p, g in zip(at[ok].tolist(), h[ok].tolist(), strict=True):
                    left, right = x[max(0, p - REACH) : p], x[p : p + LENGTH]
                    cd = _digest(left, right)
                    if what == "places":
                        out.append((g, cd, doc, d, p))
                    elif (g, cd) in again:
                        again[g, cd] += 1
                    else:
                        if len(again) >= SENT:
                            yield from told()
                        again[g, cd] = 0
                        out.append((g, cd, left[::-1], right, 1))
                    if len(out) >= ROWS:
                        yield batch()
        yield from told()
        yield batch()

    long, binary = pa.int64(), pa.binary()
    schema = {
        "places": [("h", long), ("cd", long), ("doc_id", long), ("d", long), ("at", long)],
        "contexts": [("h", long), ("cd", long), ("left", binary), ("right", binary), ("n", long)],
        "windows": [("doc_id", long), ("d", long), ("start", long), ("w", binary)],
    }[what]
    return in_batches(docs).mapInArrow(rows, ", ".join(f"{k} {'long' if t == long else 'binary'}" for k, t in schema))


def windows_of_words(docs: DataFrame, bits) -> DataFrame:  # noqa: ANN001
    """h, doc_id, d, w: of each document the hashes of its windows of PASSAGE words, by their least gram, where the bitmap has that gram."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = once(("anchors",), Anchors)
        for b in batches:
            ids, h, n, at, w, size = b.select(["doc_id", "d"]), [], [], [], [], 0
            for i in range(b.num_rows + 1):
                if i == b.num_rows or size >= CHUNK:
                    one = ids.take(pa.array(np.repeat(at, n))) if at else ids.slice(0, 0)  # without the texts: a document has a row for each of its grams
                    ends = pa.array(np.concatenate([[0], *(e for e in h_ends(h))]).astype(np.int32)) if h else pa.array([0], pa.int32())
                    flat = pa.array(np.concatenate(w)) if w else pa.array([], pa.int32())
                    grams = pa.array(np.concatenate([g for g, _ in h])) if h else pa.array([], pa.int64())
                    yield pa.RecordBatch.from_arrays([grams, one["doc_id"], one["d"], pa.ListArray.from_arrays(ends, flat)], ["h", "doc_id", "d", "w"])
                    h, n, at, w, size = [], [], [], [], 0
                if i == b.num_rows:
                    break
                x = _bytes(b.slice(i, 1))[0]
                if len(x) < 2 * PASSAGE - 1:
                    continue
                low, own = anchors.passages(x)
                if not len(low):
                    continue
                ok = _known(bits.value, low)
                low, own = low[ok], own[ok]
                if len(low):
                    first = np.flatnonzero(np.concatenate([[True], low[1:] != low[:-1]]))
                    h.append((low[first], np.append(first[1:], len(low))))
                    n.append(len(first))
                    at.append(i)
                    w.append(own)
                    size += len(own)

    return in_batches(docs.select("doc_id", "d", "text")).mapInArrow(rows, "h long, doc_id long, d long, w array<int>")


def h_ends(h: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[np.ndarray]:
    """The ends of consecutive lists, where each part's start from 0."""
    at = 0
    for _, ends in h:
        yield ends + at
        at += int(ends[-1])


def with_passages(docs: DataFrame, bits, huge: set[int]) -> DataFrame:  # noqa: ANN001
    """doc_id, d: the documents that hold a passage of PASSAGE words which a document of another id or text holds too."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def told(rows_: list[pa.RecordBatch]) -> pa.RecordBatch:
            t = pa.Table.from_batches(rows_).combine_chunks()
            h, doc, d = t["h"].to_numpy(), t["doc_id"].fill_null(-1).to_numpy(), t["d"].to_numpy()
            same = np.stack([doc, d, t["doc_id"].is_null().to_numpy().astype(np.int64)], 1)
            who = np.unique(same, axis=0, return_inverse=True)[1].reshape(-1)
            size = t["w"].combine_chunks().value_lengths().to_numpy()
            w = t["w"].combine_chunks().flatten().to_numpy().view(np.uint32).astype(np.uint64)
            key = _mixed((np.repeat(h.view(np.uint64), size) + w) * np.uint64(BASE))
            at = np.repeat(np.arange(len(h)), size)
            order = np.lexsort((who[at], key))
            key, at = key[order], at[order]
            first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            end = np.append(first[1:], len(key)) - 1
            several = who[at[first]] != who[at[end]]
            hit = np.unique(at[np.repeat(several, end - first + 1)])
            return pa.RecordBatch.from_arrays([t["doc_id"].combine_chunks().take(pa.array(hit)), pa.array(d[hit])], ["doc_id", "d"])

        for b in batches:
            h = b["h"].to_numpy()
            cut = int(np.searchsorted(h, h[-1])) if len(h) else 0  # the last gram may go on in the next batch
            if cut:
                yield told([*held, b.slice(0, cut)])
                held = []
            if len(h):
                if held and held[-1]["h"][0].as_py() != int(h[-1]):
                    yield told(held)
                    held = []
                held.append(b.slice(cut))
        if held:
            yield told(held)

    all_ = windows_of_words(docs, bits)
    few = all_.where(~F.col("h").isin(sorted(huge))) if huge else all_
    out = in_batches(few.repartition("h").sortWithinPartitions("h")).mapInArrow(rows, "doc_id long, d long")
    if huge:
        many = all_.where(F.col("h").isin(sorted(huge))).select("h", "doc_id", "d", F.explode("w").alias("w"))
        who = F.struct("doc_id", "d")
        several = many.groupBy("h", "w").agg(F.min(who).alias("a"), F.max(who).alias("b")).where("NOT a <=> b").select("h", "w")
        out = out.unionByName(many.join(several, ["h", "w"], "left_semi").select("doc_id", "d"))
    return out.distinct()


def _lcp(sorted_: list[bytes]) -> np.ndarray:
    """Lengths of the common beginnings of neighbours."""
    n = np.array([len(x) for x in sorted_])
    width = int(n.max(initial=0)) + 1
    m = np.frombuffer(b"".join(x.ljust(width, b"\0") for x in sorted_), dtype=np.uint8).reshape(len(sorted_), width)
    diff = m[1:] != m[:-1]
    first = np.where(diff.any(1), diff.argmax(1), width)
    return np.minimum(first, np.minimum(n[1:], n[:-1]))


class Levels:
    """A logarithmic family of suffix arrays over the contexts of one gram."""

    def __init__(self) -> None:
        self.levels: list[tuple[int, list, list]] = []  # rank, (right, number) sorted, (left, number) sorted
        # of each context the bytes covered, from the anchor: every match holds the anchor, so they are one run
        self.low = self.high = np.zeros(0, dtype=np.int32)

    def add(self, batch: list[tuple[bytes, bytes]]) -> None:
        first = len(self.low)
        none = np.zeros(len(batch), dtype=np.int32)
        self.low, self.high = np.concatenate([self.low, none]), np.concatenate([self.high, none])
        right = sorted((r, first + k) for k, (_, r) in enumerate(batch))
        left = sorted((x, first + k) for k, (x, _) in enumerate(batch))
        if len(batch) > 1:
            self.scan(right, left, first)
        for _, r, x in self.levels:
            self.scan(sorted(r + right), sorted(x + left), first)  # two sorted runs: merged in one pass
        self.levels.append((0, right, left))
        while len(self.levels) > 1 and self.levels[-1][0] == self.levels[-2][0]:
            (k, r, x), (_, s, y) = self.levels.pop(), self.levels.pop()
            self.levels.append((k + 1, sorted(s + r), sorted(y + x)))

    def scan(self, right: list, left: list, first: int) -> None:
        """Note the matches among contexts, one of each pair at least numbered from first on, or both below it and known already."""
        ids = np.array([k for _, k in right])
        where = {k: i for i, k in enumerate(ids.tolist())}
        order = np.array([where[k] for _, k in left])
        r, x = _lcp([s for s, _ in right]), _lcp([s for s, _ in left])
        if not len(r):
            return
        cuts = np.unique(np.clip(np.concatenate([[0], LENGTH - r, x + 1]), 0, REACH + 1))
        fresh = ids >= first
        cuts = cuts[cuts <= REACH]
        for a, b in zip(cuts.tolist(), [*(cuts[1:] - 1).tolist(), REACH], strict=True):
            # contexts agree on a bytes before the anchor and LENGTH - a from it on; so they do for all offsets up to b
            cr = np.concatenate([[0], np.cumsum(r < LENGTH - a)])
            cl = np.empty(len(ids), dtype=np.int64)
            cl[order] = np.concatenate([[0], np.cumsum(x < b if b > a else x < a)])
            both = cr * (len(ids) + 1) + cl
            _, inv, n = np.unique(both, return_inverse=True, return_counts=True)
            hit = (n > 1) & (np.bincount(inv, weights=fresh) > 0)
            if hit.any():
                i = ids[hit[inv]]
                self.low[i], self.high[i] = np.minimum(self.low[i], -b), np.maximum(self.high[i], LENGTH - a)


def resolve(contexts: DataFrame) -> DataFrame:
    """h, cd, spans: of each context the bytes, counted from its anchor, that repeat elsewhere."""

    def spans_of(group: list[list]) -> list[list[tuple[int, int]]]:
        own = [[(-min(len(left), REACH), min(len(right), LENGTH))] if n > 1 and len(left) + len(right) >= LENGTH else [] for _, left, right, n in group]
        if len(group) == 2:
            (_, la, ra, _), (_, lb, rb, _) = group
            x, r = common(la, lb), common(ra, rb)
            if x + r >= LENGTH:
                own[0].append((-x, r))
                own[1].append((-x, r))
        elif len(group) > 2:
            levels = Levels()
            for k in range(0, len(group), BATCH):
                levels.add([(left, right) for _, left, right, _ in group[k : k + BATCH]])
            own = [a + [(x, y)] * (y > 0) for a, x, y in zip(own, levels.low.tolist(), levels.high.tolist(), strict=True)]
        return [merge(s) for s in own]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, group, out = None, {}, []

        def flush() -> None:
            if group and (len(group) > 1 or next(iter(group.values()))[3] > 1):
                rows_ = list(group.values())
                for (cd, *_), s in zip(rows_, spans_of(rows_), strict=True):
                    if s:
                        out.append((now, cd, [v for ab in s for v in ab]))

        def batch() -> pa.RecordBatch:
            cols = list(zip(*out, strict=True)) if out else [[], [], []]
            return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.list_(pa.int32()))], ["h", "cd", "spans"])

        for b in batches:
            for h, cd, left, right, n in zip(*(b[c].to_pylist() for c in ("h", "cd", "left", "right", "n")), strict=True):
                if h != now:
                    flush()
                    now, group = h, {}
                held = group.setdefault(cd, [cd, None, None, 0])
                held[3] += n
                if left is not None:
                    held[1:3] = left, right
            yield batch()
            out.clear()
        flush()
        yield batch()

    return in_batches(contexts.repartition("h").sortWithinPartitions("h")).mapInArrow(rows, "h long, cd long, spans array<int>")


def common(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    return int((np.frombuffer(a, dtype=np.uint8, count=n) != np.frombuffer(b, dtype=np.uint8, count=n)).argmax())


def merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Unions of spans that overlap or touch."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def repeated(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """doc_id, d, spans: array of (a, b) of the bytes that repeat; and with_passages() of docs. docs: doc_id, d (hash of the text), text."""
    counts = durable(gram_counts(docs))
    bits = docs.sparkSession.sparkContext.broadcast(bitmap(counts))
    huge = {r.h for r in counts.where(F.col("n") > HUGE).select("h").collect()}  # as many as all anchors / HUGE
    found = resolve(occurrences(docs, bits, huge, "contexts"))
    places = occurrences(docs, bits, huge, "places").join(durable(found), ["h", "cd"])
    spans = places.select("doc_id", "d", F.explode(F.expr("transform(sequence(0, size(spans) - 1, 2), i -> named_struct('a', at + spans[i], 'b', at + spans[i + 1]))")).alias("s"))
    if huge:
        w = occurrences(docs, bits, huge, "windows")
        many = w.groupBy("w").agg(F.count("*").alias("n")).where("n > 1").select("w")
        far = w.join(many, "w").select("doc_id", "d", F.struct(F.col("start").alias("a"), (F.col("start") + LENGTH).alias("b")).alias("s"))
        spans = spans.unionByName(far)
    return spans.groupBy("doc_id", "d").agg(F.collect_set("s").alias("spans")), with_passages(docs, bits, huge)


def deduplicated(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, repeats."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("d"), F.coalesce("text", F.lit("")).alias("text"))
    spans, passages = repeated(docs)
    spans, passages = durable(spans), durable(passages.select(F.col("doc_id").alias("pid"), F.col("d").alias("pd")))
    ids = spans.select(F.col("d").alias("hit")).distinct()
    few = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    ids = F.broadcast(ids) if few else ids
    whole = docs.join(ids, F.col("d") == F.col("hit"), "left_anti")
    whole = whole.select("doc_id", "d", F.octet_length("text").cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), F.sha2("text", 256).alias("kept_sha256"))
    part = docs.join(ids, F.col("d") == F.col("hit"), "left_semi")
    s = spans.select(F.col("doc_id").alias("sid"), F.col("d").alias("sd"), "spans")
    part = part.join(s, F.col("doc_id").eqNullSafe(F.col("sid")) & (F.col("d") == F.col("sd")), "left").select("doc_id", "d", "text", "spans")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for doc, x, s in zip(b["doc_id"].to_pylist(), _bytes(b), b["spans"].to_pylist(), strict=True):
                runs = merge([(v["a"], v["b"]) for v in s or ()])
                kept, at = hashlib.sha256(), 0
                for a, e in runs:
                    kept.update(x[at:a])
                    at = e
                kept.update(x[at:])
                out.append((doc, len(x), sum(e - a for a, e in runs), len(runs), kept.hexdigest()))
            cols = list(zip(*out, strict=True)) if out else [[]] * 5
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols[:4]), pa.array(cols[4], pa.string()), b["d"]], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "d"])

    out = whole.unionByName(in_batches(part).mapInArrow(rows, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, d long"))
    few = passages.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    out = out.join(F.broadcast(passages) if few else passages, F.col("doc_id").eqNullSafe(F.col("pid")) & (F.col("d") == F.col("pd")), "left")
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", F.col("pd").isNotNull().alias("repeats"))
