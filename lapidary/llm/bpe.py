"""BPE encoding and decoding with content-defined chunk reuse.

Texts are cut where a rolling hash of the last code points says so, hence
equal passages of different documents give equal chunks; each distinct chunk
a worker meets is encoded once. A join of two chunks is repaired by encoding
anew the window between the nearest places, left and right of it, at which
any two encodings agree: where a space or newline follows a character that is
not white space, the pre-tokenizer always begins a new piece. A chunk without
such a place joins the window, which so grows until both sides agree.

New chunks of Latin text are encoded by the merge ranks of the same vocabulary,
which is faster, all others by the tokenizer itself. The caches are per Python
worker and bounded; a lost executor loses nothing but cached work.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common


SAFE = re.compile(r"(?<=\S)[ \n]")
# Fixed value: the pattern by which byte-level BPE parts a text before the merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Texts on whose pieces every regular expression engine agrees.
LATIN = re.compile("[\t\n\r\x20-\x7e\u00a1-\u00ac\u00ae-\u024f]*")
_CODECS: dict[str, "Codec"] = {}


def cuts(text: str, mean: int = 1024, least: int = 256, most: int = 1 << 14, window: int = 16) -> list[int]:
    """Ends of the chunks of a text; the last is its length. Empty for an empty text."""
    n = len(text)
    if n <= least:
        return [n] if n else []
    h = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    h = (h + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    factor, step = 0xD6E8FEB86659FD93, 1
    while step < window:  # the hash of 2k characters from two hashes of k
        low = h[:-step] if step < n else h[:0]
        h = h.copy()
        h[step:] = h[step:] + low * np.uint64(factor)
        factor, step = factor * factor % (1 << 64), step * 2
    h ^= h >> np.uint64(29)
    out, last = [], 0
    for p in (np.flatnonzero((h & np.uint64(mean - 1)) == 0) + 1).tolist():
        while p - last > most:
            last += most
            out.append(last)
        if p - last >= least and p < n:
            out.append(p)
            last = p
    while n - last > most:
        last += most
        out.append(last)
    out.append(n)
    return out


class Codec:
    """One vocabulary in one worker, with its caches."""

    def __init__(self, path: str, cache_chars: int = 6_000_000):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.cache_chars, self.held = cache_chars, 0
        self.chunks: dict[str, tuple] = {}
        self.windows: dict[str, np.ndarray] = {}
        self.encoded = 0
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        alphabet = dict(zip(map(chr, printable), printable, strict=True))
        alphabet |= {chr(256 + k): b for k, b in enumerate(sorted(set(range(256)) - set(printable)))}
        self.added = [a["content"] for a in spec["added_tokens"]]
        size = max([*spec["model"]["vocab"].values(), *(a["id"] for a in spec["added_tokens"])]) + 1
        self.bytes: list[bytes] = [b""] * size
        for piece, i in spec["model"]["vocab"].items():
            self.bytes[i] = bytes(alphabet[c] for c in piece)
        for a in spec["added_tokens"]:
            self.bytes[a["id"]] = a["content"].encode()
        self.ranked = self._ranked(spec)

    def _ranked(self, spec: dict) -> tiktoken.Encoding | None:
        """The vocabulary by merge ranks, if it is plain byte-level BPE whose ids follow its merges."""
        usual = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
        model = spec["model"]
        merges = [m if isinstance(m, str) else "".join(m) for m in model["merges"]]
        ids = [model["vocab"].get(m.replace(" ", ""), -1) for m in merges]
        plain = spec["pre_tokenizer"] == usual and not spec["normalizer"] and not model.get("ignore_merges") and not model.get("dropout")
        if not plain or ids != sorted(set(ids)) or ids[:1] < [256]:
            return None
        ranks = {self.bytes[i]: i for i in model["vocab"].values()}
        return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def _ids(self, texts: list[str], most: int = 1 << 15) -> list[np.ndarray]:
        self.encoded += sum(map(len, texts))
        fast = [self.ranked is not None and len(t) <= most and LATIN.fullmatch(t) is not None and not any(a in t for a in self.added) for t in texts]
        batch = getattr(self.tokenizer, "encode_batch_fast", self.tokenizer.encode_batch)
        slow = iter(batch([t for t, ok in zip(texts, fast, strict=True) if not ok], add_special_tokens=False))
        by_rank = lambda t: self.ranked.encode_to_numpy(t, disallowed_special=()).astype(np.int32)
        return [by_rank(t) if ok else np.array(next(slow).ids, np.int32) for t, ok in zip(texts, fast, strict=True)]

    def _learn(self, wanted: set[str]) -> None:
        new = [c for c in wanted if c not in self.chunks]
        ends = {}
        for c in new:
            first = SAFE.search(c)
            if first:
                i = len(c) - 1  # the last safe place
                while not (c[i] in " \n" and not c[i - 1].isspace()):
                    i -= 1
                ends[c] = (first.start(), i)
        sides = [s for c, (a, b) in ends.items() for s in (c[:a], c[b:])]
        ids = self._ids(new + sides)
        side = iter(ids[len(new) :])
        for c, x in zip(new, ids, strict=False):
            if c in ends:
                head, tail = next(side), next(side)
                a, b = len(head), len(x) - len(tail)
                if not (np.array_equal(x[:a], head) and np.array_equal(x[b:], tail)):
                    raise ValueError("the encodings do not agree at a boundary of the pre-tokenizer")
                self.chunks[c] = (x, *ends[c], a, b)
            else:
                self.chunks[c] = (x, -1, -1, 0, 0)
            self.held += len(c)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of whole texts, exactly as the tokenizer gives them for each text at once."""
        if self.held > self.cache_chars:
            self.chunks, self.windows, self.held = {}, {}, 0
        split = []
        for t in texts:
            at, ends = 0, cuts(t)
            pieces = []
            for e in ends:
                pieces.append(t[at:e])
                at = e
            split.append(pieces)
        self._learn({c for pieces in split for c in pieces})
        plans = []
        for pieces in split:
            plan: list = []
            if len(pieces) == 1:
                plan = [self.chunks[pieces[0]][0]]
            elif pieces:
                pending = None
                for c in pieces:
                    x, first, last, a, b = self.chunks[c]
                    if first < 0:
                        pending = (pending or "") + c
                        continue
                    if pending is None:
                        plan.append(x[:b])
                    else:
                        plan += [pending + c[:first], x[a:b]]
                    pending = c[last:]
                plan.append(pending)
            plans.append(plan)
        new = list({w for plan in plans for w in plan if isinstance(w, str)} - self.windows.keys())
        self.windows.update(zip(new, self._ids(new), strict=True))
        self.held += sum(map(len, new))
        none = np.empty(0, np.int32)
        return [np.concatenate([none, *(self.windows[w] if isinstance(w, str) else w for w in plan)]) for plan in plans]

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids, special tokens included."""
        return b"".join(map(self.bytes.__getitem__, ids.tolist())).decode("utf-8", "replace")


def codec(path: str) -> Codec:
    """The worker's codec of a vocabulary file, made once."""
    if path not in _CODECS:
        _CODECS[path] = Codec(path)
    return _CODECS[path]


def _slices(sizes: list[int], most: int) -> Iterator[tuple[int, int]]:
    start = total = 0
    for i, s in enumerate(sizes):
        if total and total + s > most:
            yield start, i
            start, total = i, 0
        total += s
    if start < len(sizes):
        yield start, len(sizes)


def encode(df: DataFrame, path: str, text: str = "text", out: str = "ids", batch_chars: int = 4_000_000) -> DataFrame:
    """df with the array<int> column `out`: the ids of each whole text (none for null or empty texts).

    path: the vocabulary file, which every executor can open. A column of df
    named like `out` in any case is left out in favour of it.
    """
    common.ship(df.sparkSession)
    df = df.drop(*[c for c in df.columns if c.lower() == out.lower() and c != text])
    schema = T.StructType([*df.schema.fields, T.StructField(out, T.ArrayType(T.IntegerType(), False), False)])
    at = df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in batches:
            texts = [t or "" for t in batch.column(at).to_pylist()]
            for a, b in _slices([len(t) for t in texts], batch_chars):
                ids = c.encode(texts[a:b])
                ends = np.cumsum([0, *map(len, ids)], dtype=np.int32)
                column = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids) if ids else [], pa.int32()))
                yield pa.RecordBatch.from_arrays([*batch.slice(a, b - a).columns, column], [*batch.schema.names, out])

    return df.mapInArrow(run, schema)


def decode(df: DataFrame, path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """df with the string column `out`: the decoded text of the array column `ids` (empty for null)."""
    common.ship(df.sparkSession)
    schema = T.StructType([*df.schema.fields, T.StructField(out, T.StringType(), False)])
    at = df.columns.index(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in batches:
            column = batch.column(at)
            values, ends = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
            texts = [c.decode(values[a:b]) for a, b in zip(ends, ends[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, out])

    return df.mapInArrow(run, schema)


def token_digests(df: DataFrame, path: str, text: str = "text", batch_chars: int = 2_000_000) -> DataFrame:
    """df without text, with n_tokens, ids_sha256 (of the decimal ids joined by commas) and
    decoded_sha256 (of the decoded text): encode, decode and digest in one pass, so that
    neither ids nor texts travel. Null texts count as empty."""
    common.ship(df.sparkSession)
    made = ["n_tokens", "ids_sha256", "decoded_sha256"]
    rest = [c for c in df.columns if c != text and c.lower() not in made]
    kinds = [T.LongType(), T.StringType(), T.StringType()]
    schema = T.StructType([*(df.schema[c] for c in rest), *(T.StructField(n, k, False) for n, k in zip(made, kinds, strict=True))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        for batch in batches:
            column, rows = batch.column(len(rest)), []
            sizes = pc.fill_null(pc.binary_length(column), 0).to_pylist()
            for a, b in _slices(sizes, batch_chars):
                for ids in c.encode([t or "" for t in column.slice(a, b - a).to_pylist()]):
                    rows.append((len(ids), sha(",".join(map(str, ids.tolist()))), sha(c.decode(ids))))
            columns = list(zip(*rows, strict=True)) or [[]] * 3
            new = [pa.array(x, k) for x, k in zip(columns, (pa.int64(), pa.string(), pa.string()), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(rest)], *new], schema.names)

    return df.select(*[F.col(f"`{c}`") for c in rest], F.col(f"`{text}`")).mapInArrow(run, schema)
