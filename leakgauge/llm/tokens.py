"""Token ids of a whole corpus by a public byte-level BPE vocabulary.

A merge can only ever build a token of the vocabulary. A pair of neighbouring
bytes that stands inside no token is therefore a certain boundary, whatever
surrounds it. Texts are cut at all such pairs, each distinct fragment is encoded
once on its own, and the ids are put together in order.

A cut must also leave the pre-tokeniser's matches as they were. Its pattern looks
ahead only behind white space and begins contractions at an apostrophe, so no cut
is made behind white space, before an apostrophe or inside a character.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leakgauge.session import spread

#: Distinct fragments that a worker keeps; beyond it the memory is emptied, never the result.
REMEMBERED, REMEMBERED_BYTES = 400_000, 32_000_000


def default_vocabulary() -> str:
    """Place of byte_bpe_50k.json as the installed public_tokenizers gives it."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_letters() -> dict[str, int]:
    """The byte of each letter that byte-level BPE files write bytes with."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(rest)}


def joined_pairs(tokens: list[bytes]) -> np.ndarray:
    """256 x 256: whether the pair of bytes stands inside some token."""
    inside = np.zeros((256, 256), dtype=bool)
    flat = np.frombuffer(b"".join(tokens), dtype=np.uint8)
    ends = np.cumsum([len(t) for t in tokens])
    between = np.ones(len(flat), dtype=bool)
    between[ends - 1] = False
    at = np.flatnonzero(between[:-1])
    inside[flat[at], flat[at + 1]] = True
    return inside


class Encoder:
    """A vocabulary file with its forced boundaries and a memory of fragments."""

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        with open(path, encoding="utf-8") as f:
            vocab = json.load(f)["model"]["vocab"]
        letters = byte_letters()
        self.inside = joined_pairs([bytes(letters[c] for c in t) for t in vocab if all(c in letters for c in t)])
        self.place: dict[bytes, int] = {}
        self.reset()

    def reset(self) -> None:
        self.place.clear()
        self.size = 0
        self.start, self.count, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def cuts(self, b: np.ndarray) -> np.ndarray:
        """Places in a byte vector before which a cut is certain."""
        if len(b) < 2:
            return np.zeros(0, dtype=np.int64)
        p, q = b[:-1], b[1:]
        ok = ~self.inside[p, q]
        ok &= (q & 0xC0) != 0x80  # never inside a character
        ok &= q != 0x27
        ok &= ~((p <= 0x20) | (p == 0x7F))
        # White space of two or three bytes: U+0085, U+00A0, U+1680, U+2000-200A, 2028, 2029, 202F, 205F, 3000.
        p1 = np.concatenate([[0], b[:-2]]).astype(np.uint8)
        p2 = np.concatenate([[0, 0], b[:-3]]).astype(np.uint8)[: len(p)]
        blank = (p1 == 0xC2) & ((p == 0x85) | (p == 0xA0))
        blank |= (p2 == 0xE2) & (p1 == 0x80) & (((p >= 0x80) & (p <= 0x8F)) | ((p >= 0xA8) & (p <= 0xAF)))
        blank |= (p2 == 0xE2) & (p1 == 0x81) | (p2 == 0xE3) & (p1 == 0x80) & (p == 0x80) | (p2 == 0xE1) & ((p1 == 0x9A) | (p1 == 0xA0))
        return np.flatnonzero(ok & ~blank) + 1

    def encode(self, texts: pa.Array) -> pa.ListArray:
        """Lists of ids; empty for empty and for null texts."""
        texts = pc.fill_null(texts, "").cast(pa.large_string())
        n = len(texts)
        offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + n + 1]
        lo, hi = int(offsets[0]) if n else 0, int(offsets[-1]) if n else 0
        raw = texts.buffers()[2].to_pybytes()[lo:hi] if hi > lo else b""
        offsets = offsets - lo
        b = np.frombuffer(raw, dtype=np.uint8)
        marks = np.zeros(len(raw) + 1, dtype=bool)
        marks[self.cuts(b)] = True
        marks[offsets] = True
        marks[[0, len(raw)]] = True
        edges = np.flatnonzero(marks)
        if len(self.place) > REMEMBERED or self.size > REMEMBERED_BYTES:
            self.reset()
        place, cut_at = self.place, edges.tolist()
        frags = [raw[s:e] for s, e in zip(cut_at, cut_at[1:])]
        new = list({f for f in frags if f not in place})
        if new:
            got = self.tokenizer.encode_batch([f.decode() for f in new], add_special_tokens=False)
            first = len(place)
            place.update((f, first + k) for k, f in enumerate(new))
            self.size += sum(map(len, new))
            counts = np.array([len(g.ids) for g in got], dtype=np.int64)
            starts = len(self.ids) + np.concatenate([[0], np.cumsum(counts)[:-1]])
            self.ids = np.concatenate([self.ids, *[np.array(g.ids, dtype=np.int32) for g in got]])
            self.start, self.count = np.concatenate([self.start, starts]), np.concatenate([self.count, counts])
        which = np.array(list(map(place.__getitem__, frags)), dtype=np.int64)
        counts = self.count[which]
        ends = np.cumsum(counts)
        total = int(ends[-1]) if len(ends) else 0
        take = np.repeat(self.start[which] - (ends - counts), counts) + np.arange(total)
        values = self.ids[take]
        before = np.concatenate([[0], ends])
        lists = before[np.searchsorted(edges, offsets)] if len(raw) else np.zeros(n + 1, np.int64)
        return pa.ListArray.from_arrays(pa.array(lists.astype(np.int32), pa.int32()), pa.array(values, pa.int32()))


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def token_ids(df: DataFrame, text: str, key: list[str], vocabulary: str | None = None, out: str = "ids") -> DataFrame:
    """``key`` columns and ``out``, the array of token ids of ``text``, one row per row.

    Null and empty texts give an empty array; a text that spells a special token is
    plain text; repeated rows are encoded alike; length is unbounded; an empty
    table gives an empty table. ``vocabulary`` is the file's place on every
    executor; it is loaded once per worker. One narrow pass, nothing is shuffled.
    """
    path = vocabulary or default_vocabulary()
    schema = df.select(*[F.col(f"`{c}`") for c in key]).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path)
        for b in batches:
            # Small slices bound the memory of a batch of very long texts.
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(k) for k in range(len(key))), e.encode(part.column(len(key)))],
                    names=[*(f"_k_{k}" for k in range(len(key))), "_ids"],
                )

    ddl = ", ".join([*(f"_k_{k} {f.dataType.simpleString()}" for k, f in enumerate(schema)), "_ids array<int>"])
    took = spread(df.select(*[F.col(f"`{c}`").alias(f"_k_{k}") for k, c in enumerate(key)], F.col(f"`{text}`").alias("_text"))).mapInArrow(run, ddl)
    return took.select(*[F.col(f"_k_{k}").alias(c) for k, c in enumerate(key)], F.col("_ids").alias(out))
