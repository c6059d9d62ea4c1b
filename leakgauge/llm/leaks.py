"""Held-out test passages inside a training corpus.

Both sides are brought to plain words (case, accents, punctuation, layout,
mark-up, escapes and wrong decoding undone). Spaced seeds then find where they
meet: five masks select five words of a window, four of them ignoring one word
inside. A seed names its mask. The test side also gives its full windows the names
of the spaced masks and its spaced windows the name of the full one, so a word
changed, added or left out between the selected ones does no harm, and no other
windows meet. Every passage with the share of words kept that is asked for has at
least two seeds at different places (proved over all cases in the tests), so a
lone one is dropped before anything is joined. Around the hits a local alignment
counts the words in order and the edits between them.

The corpus side is one narrow pass behind a filter of fixed size made of the test
side's seeds; what passes it meets the seeds themselves in a hash join. Equal items
and equal stretches are worked on once, however many copies there are.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leakgauge.llm import mojibake
from leakgauge.llm.lookalikes import RESEMBLES
from leakgauge.session import cut, spread

#: Selected places of each seed; the full window first.
MASKS = ((0, 1, 2, 3, 4), (0, 2, 3, 4, 5), (0, 1, 3, 4, 5), (0, 1, 2, 4, 5), (0, 1, 2, 3, 5))
#: A passage has at least so many words of the item's text in order.
PASSAGE = 12
#: About one word in eight may differ: least share of words kept.
KEPT = 0.78
#: Words around a hit that the alignment sees.
MARGIN = 40
#: Bits of the filter (a power of two; 8 MB, whatever the test side holds). A fuller filter lets more through, nothing is lost.
FILTER_BITS = 1 << 26
#: Pairs of equal words from which the alignment goes by vectors of places.
DENSE = 20_000

_WORD = re.compile(r"[^\W_]+")
_BREAK = re.compile(r"(?<=\w)[-\u2010\u00ad\u00ac]\s*\r?\n[\s>*#|]*(?=\w)")
_BLOCK = re.compile(r"</?(?:br|p|div|li|ul|ol|tr|td|th|table|h[1-6]|hr|blockquote|pre|section|article)\b[^<>]{0,200}>", re.I)
_TAG = re.compile(r"<(?:/?[A-Za-z][^<>]{0,200}|!--.{0,200}?--)>", re.S)
_LINK = re.compile(r"\]\([^()\s]{1,300}\)")
_TEX = re.compile(r"\\(?:[A-Za-z]{2,12}\*?)(?=\{)")
_U = re.compile(r"\\u([0-9a-fA-F]{4})")
_SILENT = "\u00ad\u200b\u200c\u200d\u200e\u200f\u2060\ufeff"
_MARKS = "\u0327\u0328\u0326\u0300\u0301\u0302\u0303\u0304\u0306\u0307\u0308\u030a\u030c"
_FOLD = {ord(a): b for a, b in zip("ıçğöşüâîûýþðéèêáàíóúãõäëïñ", "icgosuaiuisgeeeaaiouaoaein")} | {ord(c): None for c in _SILENT + _MARKS}
_FOREIGN = {ord(c): p[-1] for c, p in RESEMBLES.items() if c.islower() and len(p) and p[-1].isascii()}


_RAW = re.compile("(?:[^\\W_]|[\u0300-\u036f\u00ad\u200b-\u200f\u2060\ufeff])+")
_COMBINING = re.compile("[\u0300-\u036f\u1ab0-\u1aff\u20d0-\u20ff]+")


def bare(s: str) -> str:
    """Text without mark-up, escapes, line-end hyphens and wrong decoding."""
    if "\\u" in s:
        s = _U.sub(lambda m: chr(int(m[1], 16)), s)
    if "\\" in s:
        s = _TEX.sub(" ", s.replace("\\n", "\n").replace('\\"', '"'))
    if "&" in s:
        s = html.unescape(s)
    if "<" in s:
        s = _TAG.sub("", _BLOCK.sub("\n", s))
    if "](" in s:
        s = _LINK.sub("] ", s)
    if not s.isascii():
        s = mojibake.search(s)[0]
    return _BREAK.sub("", s) if "\n" in s else s


def fold(w: str) -> list[str]:
    """Plain words of one token: no case, accents, widths, look-alikes, silent characters."""
    w = unicodedata.normalize("NFC", w).lower()
    if not w.isascii():
        w = w.translate(_FOLD)
        if not w.isascii():
            w = _COMBINING.sub("", unicodedata.normalize("NFKD", w).translate(_FOLD))
            if any("a" <= c <= "z" for c in w):
                w = w.translate(_FOREIGN)
    return _WORD.findall(w)


def words(s: str | None) -> list[str]:
    return [x for w in _RAW.findall(bare(s)) for x in fold(w)] if s else []


#: Hashes of the tokens a worker has met; a token is nearly always one word.
_SEEN: dict[str, int | tuple[int, ...]] = {}


def word_hashes(ws: list[str]) -> np.ndarray:
    """Hashes of the plain words of raw tokens, in order."""
    if len(_SEEN) > 500_000:
        _SEEN.clear()
    get, many = _SEEN.get, False
    got = [get(w) for w in ws]
    for i, h in enumerate(got):
        if h is None:
            h = get(ws[i])
            if h is None:
                hs = tuple(xxhash.xxh64_intdigest(x.encode()) - (1 << 63) for x in fold(ws[i]))
                h = hs[0] if len(hs) == 1 else hs
                if len(ws[i]) <= 60:
                    _SEEN[ws[i]] = h
            got[i] = h
        if type(h) is tuple:
            many = True
    if many:
        got = [x for h in got for x in (h if type(h) is tuple else (h,))]
    return np.array(got, dtype=np.int64)


def text_hashes(s: str | None) -> np.ndarray:
    return word_hashes(_RAW.findall(bare(s))) if s else np.zeros(0, np.int64)


_NAMES = (np.arange(len(MASKS), dtype=np.uint64) + np.uint64(1)) * np.uint64(0xC2B2AE3D27D4EB4F)


def _named(x: np.ndarray, mask: int) -> np.ndarray:
    y = (x ^ _NAMES[mask]) * np.uint64(0x9E3779B97F4A7C15)
    return (y ^ (y >> np.uint64(32))).view(np.int64)


def seeds(h: np.ndarray, bounds: np.ndarray | None = None, tests: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first place of every seed in a vector of word hashes.

    ``bounds`` holds where texts begin and end in the vector (first 0, last its
    length); a seed never reaches from one text into the next. ``tests`` gives the
    seeds of the test side, which bear the names of the masks they may meet.
    """
    hashes, places = [], []
    u = h.view(np.uint64)
    if bounds is not None:
        room = np.repeat(bounds[1:], np.diff(bounds))  # where the text of each word ends
    for m, mask in enumerate(MASKS):
        n = len(h) - mask[-1]
        if n <= 0:
            continue
        x = np.zeros(n, dtype=np.uint64)
        for k in mask:
            x = (x ^ u[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
            x ^= x >> np.uint64(29)
        at = np.arange(n)
        if bounds is not None:
            fits = at + mask[-1] < room[:n]
            x, at = x[fits], at[fits]
        for name in (range(len(MASKS)) if m == 0 else (0, m)) if tests else (m,):
            hashes.append(_named(x, name))
            places.append(at)
    if not hashes:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(hashes), np.concatenate(places)


#: Where the three bits of a seed stand in the filter: bits of the seed from these on.
_SHIFTS = (0, 19, 38)


class Filter:
    """Membership in a set of hashes with few false and no missing answers; ``table`` holds the bits."""

    def __init__(self, table: np.ndarray) -> None:
        self.table = table
        self.mask = np.uint64(len(table) * 64 - 1)

    def hits(self, s: np.ndarray) -> np.ndarray:
        """Places in ``s`` of the hashes that may be members."""
        maybe = np.arange(len(s))
        u = s.view(np.uint64)
        for shift in _SHIFTS:
            at = (u[maybe] >> np.uint64(shift)) & self.mask
            maybe = maybe[(self.table[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) == 1]
        return maybe


def filter_table(seed_table: DataFrame, bits: int) -> np.ndarray:
    """Bits of all seeds, set by an aggregate; at most one row for each 64 of them reaches the driver."""
    slots = F.array(*[F.shiftrightunsigned("seed", k).bitwiseAND(F.lit(bits - 1).cast("bigint")) for k in _SHIFTS])
    words = seed_table.select(F.explode(slots).alias("slot")).select(F.shiftrightunsigned("slot", 6).alias("at"), F.expr("shiftleft(1L, cast(slot & 63 as int))").alias("bit"))
    got = words.groupBy("at").agg(F.bit_or("bit").alias("bits")).toArrow()
    table = np.zeros(bits // 64, dtype=np.int64)
    table[got["at"].to_numpy()] = got["bits"].to_numpy()
    return table.view(np.uint64)


def align(doc: np.ndarray, item: np.ndarray) -> tuple[int, int]:
    """``(words in order, edits between them)`` of the best local alignment.

    A chain of equal words, rising on both sides, in which every word changed,
    added or left out costs as much as one kept word earns. Where the best is too
    thin for a passage but holds or hides one, that one is given.
    """
    at: dict[int, list[int]] = {}
    for j, w in enumerate(item.tolist()):
        at.setdefault(w, []).append(j)
    met = [(i, at[w]) for i, w in enumerate(doc.tolist()) if w in at]
    if sum(len(js) for _, js in met) > DENSE:
        return align_dense(met, len(item))
    points = [(i, j) for i, js in met for j in js]
    best, top = [], (0.0, 0, 0)
    lo = 0
    for k, (i, j) in enumerate(points):
        while points[lo][0] < i - 9:
            lo += 1
        score, kept, edits = 1.0, 1, 0
        for p in range(lo, k):
            a, b = points[p]
            if a < i and b < j:
                e = max(i - a, j - b) - 1
                if e <= 8:
                    s = best[p][0] - e + 1.0
                    if s > score or s == score and best[p][1] + 1 > kept:
                        score, kept, edits = s, best[p][1] + 1, best[p][2] + e
        best.append((score, kept, edits))
        if (score, kept) > top[:2]:
            top = (score, kept, edits)
    # No passage has a lower score than the least share of the fewest words leaves.
    if not is_passage(*top[1:]) and top[0] >= (2 * KEPT - 1) * PASSAGE:
        return hidden(points) or top[1:]
    return top[1], top[2]


def align_dense(met: list[tuple[int, list[int]]], n: int) -> tuple[int, int]:
    """The same best chain where words repeat so often that pairs of points are too many.

    One vector of the item's places for each word of the text; the last nine are
    looked back on. Score and kept words are held in one number, as edits are their
    difference. Work is linear in the text's length times the item's.
    """
    big = np.int64(1) << 32
    least = -(np.int64(1) << 60)
    recent: list[tuple[int, np.ndarray]] = []
    top = 0
    for i, js in met:
        recent = [(a, row) for a, row in recent if a >= i - 9]
        here = np.full(n, big + 1, dtype=np.int64)  # a chain that begins: score 1, kept 1
        for a, row in recent:
            for step in range(1, min(9, n - 1) + 1):
                e = max(i - a, step) - 1
                np.maximum(here[step:], row[:-step] + (1 - e) * big + 1, out=here[step:])
        now = np.full(n, least, dtype=np.int64)
        now[js] = here[js]
        recent.append((i, now))
        top = max(top, int(now.max()))
    kept = top & 0xFFFFFFFF
    return kept, kept - (top >> 32)


def hidden(points: list[tuple[int, int]]) -> tuple[int, int] | None:
    """Words and edits of the first passage among the best chains from each start to each end.

    Neither end of a chain may lose: whatever is cut off there has to earn its edits.
    """
    for start, (i0, j0) in enumerate(points):
        # Place in the text and in the item, score, kept, edits, highest score on the way.
        live = [(i0, j0, 1, 1, 0, 1)]
        lo = 0
        for i, j in points[start + 1 :]:
            while lo < len(live) and live[lo][0] < i - 9:
                lo += 1
            if lo == len(live):
                break
            got = None
            for a, b, score, kept, edits, high in live[lo:]:
                if a < i and b < j:
                    e = max(i - a, j - b) - 1
                    if e <= 8 and e <= score and (got is None or (score - e + 1, kept + 1) > got[:2]):
                        got = (score - e + 1, kept + 1, edits + e, max(high, score - e + 1))
            if got:
                live.append((i, j, *got))
                if got[0] == got[3] and is_passage(got[1], got[2]):
                    return got[1], got[2]
    return None


def is_passage(kept: int, edits: int, passage: int = PASSAGE, share: float = KEPT) -> bool:
    return kept + edits >= passage and kept >= share * (kept + edits)


def _class(h: np.ndarray) -> str:
    """Equal for equal vectors of words."""
    return xxhash.xxh3_128_hexdigest(np.ascontiguousarray(h).tobytes())


def found(docs: DataFrame, doc_text: str, doc_key: str, items: DataFrame, item_text: str, item_key: str, filter_bits: int = FILTER_BITS) -> DataFrame:
    """``doc_key, item_key`` of every document with a passage of an item.

    Null and empty texts on either side give no row; nor do items of fewer than
    ``PASSAGE`` words; repeated documents and items are each reported; a pair is
    reported once; lengths are unbounded; empty tables give an empty table.
    """
    candidates, members, owners = candidate_pairs(docs, doc_text, doc_key, items, item_text, item_key, filter_bits)

    @F.pandas_udf("boolean")
    def verify(part: pd.Series, item: pd.Series) -> pd.Series:
        return pd.Series([is_passage(*align(np.asarray(a), np.asarray(b))) for a, b in zip(part, item)], dtype=bool)

    told = candidates.where(verify("part", "words")).select("pc", "ic")
    return told.join(members, "pc").join(owners, "ic").select(F.col("doc").alias(doc_key), F.col("item").alias(item_key)).distinct()


def candidate_pairs(docs: DataFrame, doc_text: str, doc_key: str, items: DataFrame, item_text: str, item_key: str, filter_bits: int = FILTER_BITS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``pc, ic, part, words`` of the classes of stretches and items with enough seeds in common, and who belongs to either."""

    def vectors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            hs = [text_hashes(t) for t in b["text"]]
            yield pd.DataFrame({"item": b["item"], "ic": [_class(h) for h in hs], "words": hs})[[len(h) >= PASSAGE for h in hs]]

    kind = items.schema[item_key].dataType.simpleString()
    asked = items.select(F.col(f"`{item_key}`").alias("item"), F.col(f"`{item_text}`").alias("text")).where(F.length("text") > 0)
    asked = cut(asked.mapInPandas(vectors, f"item {kind}, ic string, words array<long>"))
    owners = asked.select("item", "ic")
    classes = asked.groupBy("ic").agg(F.first("words").alias("words"))

    @F.pandas_udf("array<long>")
    def test_seeds(words: pd.Series) -> pd.Series:
        return words.map(lambda h: np.unique(seeds(np.asarray(h, dtype=np.int64), tests=True)[0]))

    seed_table = cut(classes.select("ic", F.explode(test_seeds("words")).alias("seed")))
    table = docs.sparkSession.sparkContext.broadcast(filter_table(seed_table, filter_bits))
    kind = docs.schema[doc_key].dataType.simpleString()

    def stretches_of(ids: list, vectors: list[np.ndarray], known: Filter) -> Iterator[tuple]:
        """Id, class, seeds with their places, and words of each stretch with enough hits, the texts taken together."""
        bounds = np.concatenate([[0], np.cumsum([len(v) for v in vectors])])
        h = np.concatenate(vectors) if vectors else np.zeros(0, np.int64)
        s, p = seeds(h, bounds)
        hit = known.hits(s)
        s, p = s[hit], p[hit]
        order = np.argsort(p, kind="stable")
        s, p = s[order], p[order]
        doc = np.searchsorted(bounds, p, side="right") - 1
        # Hits of one text closer than the margin belong to one stretch.
        breaks = np.flatnonzero((np.diff(p) > MARGIN) | (np.diff(doc) > 0)) + 1
        for g in np.split(np.arange(len(p)), breaks) if len(p) else ():
            if p[g[0]] == p[g[-1]]:
                continue  # a passage has seeds at two places
            d = doc[g[0]]
            lo, hi = max(bounds[d], p[g[0]] - MARGIN), min(bounds[d + 1], p[g[-1]] + MARGIN + 6)
            yield ids[d], _class(h[lo:hi]), s[g], p[g] - lo, h[lo:hi]

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = Filter(table.value)
        for b in batches:
            ids, vectors, size, out = [], [], 0, []
            for d, t in zip(b["doc"], b["text"]):
                v = text_hashes(t)
                ids.append(d)
                vectors.append(v)
                size += len(v)
                if size > 500_000:  # a bound on memory; texts are never cut
                    out += stretches_of(ids, vectors, known)
                    ids, vectors, size = [], [], 0
            out += stretches_of(ids, vectors, known)
            if out:
                yield pd.DataFrame({"doc": pd.Series([o[0] for o in out], dtype=b["doc"].dtype), **{c: pd.Series([o[k] for o in out], dtype=object) for k, c in enumerate(("pc", "seeds", "places", "part"), 1)}})

    rows = docs.select(F.col(f"`{doc_key}`").alias("doc"), F.col(f"`{doc_text}`").alias("text")).where(F.length("text") > 0)
    parts = cut(spread(rows).mapInPandas(scan, f"doc {kind}, pc string, seeds array<long>, places array<long>, part array<long>"))
    members = parts.select("doc", "pc")
    stretches = parts.groupBy("pc").agg(F.first("seeds").alias("seeds"), F.first("places").alias("places"), F.first("part").alias("part"))
    hits = stretches.select("pc", F.explode(F.arrays_zip("seeds", "places")).alias("x")).select("pc", F.col("x.seeds").alias("seed"), F.col("x.places").alias("place"))
    # Seeds are few after the filter; a hot one is split by the adaptive join. Two places are
    # asked of each pair before words are fetched.
    pairs = hits.join(seed_table, "seed").groupBy("pc", "ic").agg(F.min("place").alias("lo"), F.max("place").alias("hi")).where("lo < hi").select("pc", "ic")
    return pairs.join(stretches.select("pc", "part"), "pc").join(classes, "ic"), members, owners
