"""SentencePiece encoding and decoding on the tokenizers library.

The model file's protobuf is parsed here; the normaliser, the metaspace marker, the scores (unigram) or merges (BPE, in the order of the scores) and the
byte fallback are rebuilt as a tokenizers pipeline, which encodes batches on several threads. Where no piece has a marker after another character, no merge can
cross such a place, so texts are cut there first and words come from the library's cache; else texts are encoded uncut.

Defined cases: a null text is empty, an empty one has no tokens; a literal U+2581 reads back as a space, as in the original library; texts are encoded whole; repeated rows
give repeated rows; other columns are left alone; an empty table gives no rows.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from gyeol.llm.common import in_batches, once

DEFAULT_MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Bytes that a model file may have to be sent to every executor.
MODEL_LIMIT = 64 << 20
MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
#: Characters of text that are encoded at once, and distinct words that a worker remembers.
BATCH, WORDS = 1 << 18, 100_000
#: Words that are one sequence to the library, and its threads in a worker, which has cores of an executor and not of the machine.
SEQUENCE, THREADS = 200, "2"
WORD = re.compile("\n+| *[^ \n]+| +")


def fields(buf: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a protobuf message; values of length-delimited and fixed fields are bytes."""
    at = 0

    def varint() -> int:
        nonlocal at
        out = shift = 0
        while True:
            b = buf[at]
            at += 1
            out |= (b & 127) << shift
            shift += 7
            if b < 128:
                return out

    while at < len(buf):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
            continue
        n = {1: 8, 5: 4}.get(kind)
        if n is None:
            if kind != 2:
                raise ValueError(f"wire type {kind} at byte {at}")
            n = varint()
        yield key >> 3, buf[at : at + n]
        at += n


@dataclass
class Model:
    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    kind: int = 1
    byte_fallback: bool = False
    charsmap: bytes = b""
    dummy_prefix: bool = True
    squeeze: bool = True
    escape: bool = True


def parse(data: bytes) -> Model:
    m = Model()
    for k, v in fields(data):
        if k == 1:
            d = dict(fields(v))
            m.pieces.append((d.get(1, b"").decode(), struct.unpack("<f", d[2])[0] if 2 in d else 0.0, d.get(3, NORMAL)))
        elif k == 2:
            d = dict(fields(v))
            m.kind, m.byte_fallback = d.get(3, 1), bool(d.get(35, 0))
        elif k == 3:
            d = dict(fields(v))
            m.charsmap, m.dummy_prefix, m.squeeze, m.escape = d.get(2, b""), bool(d.get(3, 1)), bool(d.get(4, 1)), bool(d.get(5, 1))
    return m


def build(m: Model):  # noqa: ANN201
    """The tokenizers pipeline of a parsed model."""
    os.environ.setdefault("RAYON_NUM_THREADS", THREADS)
    from tokenizers import Regex, Tokenizer, decoders, models, normalizers, pre_tokenizers

    unk = next((i for i, p in enumerate(m.pieces) if p[2] == UNKNOWN), None)
    if m.kind == 1:
        model = models.Unigram([(p, s) for p, s, _ in m.pieces], unk, m.byte_fallback)
    elif m.kind == 2:
        vocab = {p: i for i, (p, _, _) in enumerate(m.pieces)}
        made = {p for p, _, t in m.pieces if t in (NORMAL, USER)}
        ranked = sorted((-s, i, p) for i, (p, s, t) in enumerate(m.pieces) if t in (NORMAL, USER) and len(p) > 1)
        merges = [(p[:k], p[k:]) for _, _, p in ranked for k in range(1, len(p)) if p[:k] in made and p[k:] in made]
        model = models.BPE(vocab, merges, unk_token=None if unk is None else m.pieces[unk][0], fuse_unk=True, byte_fallback=m.byte_fallback)
    else:
        raise ValueError(f"model type {m.kind}")
    tok = Tokenizer(model)
    steps = []
    if m.charsmap:
        steps.append(normalizers.Precompiled(m.charsmap))
    if m.squeeze:
        steps += [normalizers.Replace(Regex(" {2,}"), " "), normalizers.Strip()]
    if m.dummy_prefix:
        steps.append(normalizers.Prepend(MARK if m.escape else " "))
    if m.escape:
        steps.append(normalizers.Replace(" ", MARK))
    if steps:
        tok.normalizer = normalizers.Sequence(steps)
    if m.kind == 2 and not any(MARK in p.lstrip(MARK) for p, _, t in m.pieces if t in (NORMAL, USER)):
        tok.pre_tokenizer = pre_tokenizers.Split(Regex(f"{MARK}*[^{MARK}]+|{MARK}+"), "isolated")
    tail = [decoders.Strip(" ", 1, 0)] if m.dummy_prefix else []
    tok.decoder = decoders.Sequence([decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse(), *tail])
    return tok


class Encoder:
    """Texts to ids, as the pipeline gives them. Where words can be encoded apart, each distinct one is encoded once (in batches, on several threads) and
    remembered up to about WORDS of them; else whole texts are encoded in batches."""

    def __init__(self, model: Model) -> None:
        from tokenizers import Tokenizer

        self.model, self.table, self.pipeline = model, table_of(model), build(model)
        self.apart = self.pipeline.pre_tokenizer is not None and not model.charsmap and not model.squeeze and model.dummy_prefix and model.escape and not any("\n" in p for p, _, _ in model.pieces)
        self.words = Tokenizer(self.pipeline.model)
        line = self.words.encode("\n", add_special_tokens=False).ids
        self.line = line[0] if len(line) == 1 and model.pieces[line[0]][2] == BYTE else None
        self.seen: dict[str, bytes] = {}
        self.other: set[str] = set()  # words of seen whose ids do not decode to them

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, four bytes each."""
        return self.checked(texts)[0]

    def checked(self, texts: list[str]) -> tuple[list[bytes], list[bool]]:
        """The ids of each text, four bytes each, and whether they decode to the text as it is normalised.

        Bytes of ids are joined in decoding, and words in a text; so where each word's ids decode to the word, the text's do to the text, and a word is decoded once."""
        if not self.apart:
            ids = [np.array(e.ids, dtype=np.int32).tobytes() for e in self.pipeline.encode_batch_fast(texts, add_special_tokens=False)]
            return ids, [self.reads_back(t, x) for t, x in zip(texts, ids, strict=True)]
        split = [self.split(t) for t in texts]
        seen, told = self.seen, self.table.__getitem__
        here = set(chain.from_iterable(split))
        new = list(here.difference(seen))
        if len(seen) + len(new) > WORDS:  # words that two batches have in common stay
            kept = {w: seen[w] for w in here.difference(new)}
            seen.clear()
            seen.update(kept)
        for k in range(0, len(new), 10_000):
            part = new[k : k + 10_000]
            ids = self.each(part)
            seen.update(zip(part, ids, strict=True))
            for i in range(0, len(part), SEQUENCE):  # decoded many at once, and one by one only where that differs
                if b"".join(map(told, np.frombuffer(b"".join(ids[i : i + SEQUENCE]), dtype=np.int32).tolist())) != "".join(part[i : i + SEQUENCE]).encode(errors="surrogatepass"):
                    self.other.update(w for w, x in zip(part[i : i + SEQUENCE], ids[i:], strict=False) if b"".join(map(told, np.frombuffer(x, dtype=np.int32).tolist())) != w.encode(errors="surrogatepass"))
        get, other = seen.__getitem__, self.other
        ids = [b"".join(map(get, ws)) for ws in split]
        return ids, [not other or other.isdisjoint(ws) or self.reads_back(t, x) for t, ws, x in zip(texts, split, ids, strict=True)]

    def each(self, words: list[str]) -> list[bytes]:
        """The ids of each word, four bytes each. Many words go to the library as one sequence, with line ends between them: no other word has the id of a line end."""
        if self.line is None:
            return [array("i", e.ids).tobytes() for e in self.words.encode_batch_fast([w.replace(" ", MARK) for w in words], add_special_tokens=False)]
        out, lines = [], [w for w in words if "\n" in w]
        if lines:
            told = dict(zip(lines, (array("i", e.ids).tobytes() for e in self.words.encode_batch_fast(lines, add_special_tokens=False)), strict=True))
        plain = [w.replace(" ", MARK) for w in words if "\n" not in w] if lines else [w.replace(" ", MARK) for w in words]
        parts = [[x for w in plain[k : k + SEQUENCE] for x in (w, "\n")] for k in range(0, len(plain), SEQUENCE)]
        for e in self.words.encode_batch_fast(parts, is_pretokenized=True, add_special_tokens=False):
            ids = np.array(e.ids, dtype=np.int32)
            ends = (np.flatnonzero(ids == self.line) * 4).tolist()
            b = ids.tobytes()
            out += [b[a:z] for a, z in zip([0, *(z + 4 for z in ends)], ends, strict=False)]
        if lines:
            rest = iter(out)
            return [told[w] if w in told else next(rest) for w in words]
        return out

    def reads_back(self, text: str, ids: bytes) -> bool:
        back = joined(map(self.table.__getitem__, np.frombuffer(ids, dtype=np.int32).tolist()), self.model.dummy_prefix)
        return back == text or back == shown(self.pipeline.normalizer, text)

    @staticmethod
    def split(text: str) -> list[str]:
        """Words with the marks before them, and line ends; cut where no piece spans the place."""
        if not text:
            return []
        text = " " + text.replace(MARK, " ")
        return WORD.findall(text)


def encode(docs: DataFrame, model_path: str = DEFAULT_MODEL) -> DataFrame:
    """doc_id, n_chars, n_tokens, ids, round_trip: whether the ids decode to the text (as normalised)."""
    spark: SparkSession = docs.sparkSession
    shared = spark.sparkContext.broadcast(read_model(model_path))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = once(("pieces", zlib.crc32(shared.value)), lambda: Encoder(parse(shared.value)))
        for b in batches:
            for part in slices(b):
                texts = [t or "" for t in part["text"].to_pylist()]
                ids, same = enc.checked(texts)
                flat = np.frombuffer(b"".join(ids), dtype=np.int32)
                n = [len(x) // 4 for x in ids]
                ends = pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [part["doc_id"].cast(pa.int64()), pa.array([len(t) for t in texts], pa.int64()), pa.array(n, pa.int64()), pa.ListArray.from_arrays(ends, pa.array(flat)), pa.array(same, pa.bool_())],
                    ["doc_id", "n_chars", "n_tokens", "ids", "round_trip"],
                )

    return in_batches(docs.select("doc_id", "text")).mapInArrow(rows, "doc_id long, n_chars long, n_tokens long, ids array<int>, round_trip boolean")


def table_of(model: Model) -> list[bytes]:
    """The bytes that each id stands for."""
    return [bytes([int(p[3:5], 16)]) if t == BYTE else p.replace(MARK, " ").encode() for p, _, t in model.pieces]


def joined(parts: Iterator[bytes], dummy_prefix: bool) -> str:
    out = b"".join(parts)
    return (out[1:] if dummy_prefix and out.startswith(b" ") else out).decode(errors="replace")


def decode(model: Model, ids: list[int]) -> str:
    """The text of ids: the same as the pipeline's decoder gives, by a table of bytes."""
    return joined(map(table_of(model).__getitem__, ids), model.dummy_prefix)


def shown(normal, text: str) -> str:  # noqa: ANN001
    """What a normalised text reads back as."""
    t = (normal.normalize_str(text) if normal else text).replace(MARK, " ")
    return t[1:] if t.startswith(" ") else t


def slices(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Consecutive rows of about BATCH bytes, at least one each."""
    at = size = 0
    for i, n in enumerate(pc.fill_null(pc.binary_length(b["text"]), 0).to_pylist()):
        size += n
        if size >= BATCH:
            yield b.slice(at, i + 1 - at)
            at, size = i + 1, 0
    if at < b.num_rows:
        yield b.slice(at)


def read_model(path: str) -> bytes:
    with open(path, "rb") as f:
        data = f.read(MODEL_LIMIT + 1)
    if len(data) > MODEL_LIMIT:
        raise ValueError(f"{path}: over {MODEL_LIMIT} bytes")
    return data
