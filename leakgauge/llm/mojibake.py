"""Text decoded with a wrong character encoding: find it and restore it.

Each stretch of a text (a sentence or line with a suspicious character) is the
start of a best-first search. Its moves take what is there back to the bytes of
one encoding and decode those with another, or resolve escapes; a hash of every
state visited keeps the search from going round. The cost of a state is how
implausible its characters are where they stand, plus a small cost for each move;
the cheapest reachable text is the result.

Moves from one letter to another letter of the same plausibility (thorn for s
with cedilla) can't be told by characters alone: for stretches with such letters
the search runs once more with a price that also holds how often the corpus
writes the words either way.
"""

from __future__ import annotations

import codecs
import heapq
import html
import re
import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leakgauge.functions.cache import short_cache
from leakgauge.session import cut, spread

#: Encodings that UTF-8 bytes get read as, and single-byte ones that get confused.
AS_UTF8 = ("cp1252", "cp1254", "mac_roman", "cp437", "cp850", "cp857", "cp1251", "cp1250", "iso8859_15", "mac_turkish", "iso8859_2", "cp866", "koi8_r", "cp1253", "cp852")
SWAPS = tuple((a, b) for a in ("cp1252", "mac_roman", "cp437", "cp850", "cp1251", "cp1250", "cp857") for b in ("cp1254", "cp857", "mac_turkish", "cp1252", "cp850") if a != b)
LOST = "\ufffd"
#: Texts without any of these need no look: C1 controls, signs and foreign letters.
SUSPECT = r"[^\x00-\x7FçğıöşüÇĞİÖŞÜâîûÂÎÛ“”’‘—–…]"


@lru_cache(maxsize=64)
def to_bytes(name: str) -> dict[str, int]:
    """Character to byte of one encoding. Bytes it leaves open are C1 controls."""
    table = {}
    for b in range(128, 256):
        try:
            table[codecs.decode(bytes([b]), name)] = b
        except UnicodeDecodeError:
            table[chr(b)] = b
    if name == "cp1252":  # Latin-1 readers give controls where Windows has signs
        for b in range(128, 160):
            table.setdefault(chr(b), b)
    return table


@lru_cache(maxsize=64)
def from_byte(name: str) -> list[str]:
    out = []
    for b in range(256):
        try:
            out.append(codecs.decode(bytes([b]), name))
        except UnicodeDecodeError:
            out.append(LOST)
    return out


@lru_cache(maxsize=64)
def _lead(name: str) -> re.Pattern:
    """A lead byte's character of ``name`` before a continuation byte's."""
    back = {b: c for c, b in reversed(list(to_bytes(name).items()))}
    every = {b: "".join(re.escape(c) for c, x in to_bytes(name).items() if x == b) for b in back}
    lead, follow = ("".join(every[b] for b in r if b in every) for r in (range(0xC2, 0xF5), range(0x80, 0xC0)))
    return re.compile(f"[{lead}][{follow}]")


_UTF8 = re.compile(rb"[\xC2-\xDF][\x80-\xBF]|[\xE0-\xEF][\x80-\xBF]{2}|[\xF0-\xF4][\x80-\xBF]{3}")
_HIGH = re.compile(r"[^\x00-\x7F]+")


def as_utf8(s: str, name: str) -> str:
    """Every stretch that is valid UTF-8 in the bytes of ``name``, decoded."""
    table = to_bytes(name)

    def one(m: re.Match) -> str:
        out, run = [], bytearray()

        def flush() -> None:
            b, at = bytes(run), 0
            for u in _UTF8.finditer(b):
                out.extend(back[x] for x in b[at : u.start()])
                try:
                    out.append(u[0].decode())
                except UnicodeDecodeError:
                    out.extend(back[x] for x in u[0])
                at = u.end()
            out.extend(back[x] for x in b[at:])
            run.clear()
            back.clear()

        back: dict[int, str] = {}
        for c in m[0]:
            b = table.get(c)
            if b is None or back.get(b, c) != c:
                flush()
            if b is None:
                out.append(c)
            else:
                back[b] = c
                run.append(b)
        flush()
        return "".join(out)

    return _HIGH.sub(one, s)


@lru_cache(maxsize=128)
def _swap_table(src: str, dst: str) -> dict[int, str]:
    to, back = to_bytes(src), from_byte(dst)
    # Blanks and soft hyphens stay: they stand in correct text as well.
    return {ord(c): back[b] for c, b in to.items() if back[b] not in (c, LOST) and back[b].isalpha() and c not in "\xa0\xad"}


def unescaped(s: str) -> str:
    s = html.unescape(s) if "&" in s else s
    return re.sub(r"\\u([0-9a-fA-F]{4})|\\x([0-9a-fA-F]{2})", lambda m: chr(int(m[1] or m[2], 16)), s) if "\\" in s else s


_TURKISH = frozenset("çğıöşüÇĞİÖŞÜ")
_QUOTES = frozenset("“”‘’„«»…—–")
#: Letters that Windows-1252 gives for the second byte of a UTF-8 pair.
_TRAILERS = frozenset("ŠŒŽšœžŸƒ")


@lru_cache(maxsize=8192)
def _kind(c: str) -> str:
    o = ord(c)
    if o < 128:
        return "a" if c.isalpha() else "d" if c.isdigit() else "c" if o < 32 and c not in "\n\r\t" else "p"
    if c == LOST:
        return "?"
    if c in _TURKISH:
        return "t"
    if c in _QUOTES:
        return "q"
    cat = unicodedata.category(c)
    if cat == "Cc":
        return "c"
    if cat == "Co" or cat == "Cn":
        return "c"
    if cat[0] == "L" and cat not in ("Lo", "Lm") or o in (0xAA, 0xBA) or cat == "Lo":
        n = unicodedata.name(c, "")
        if n.startswith("LATIN"):
            return "l" if o < 0x180 else "r"
        if o in (0xAA, 0xBA):
            return "s"
        return "G" if n.startswith("GREEK") else "C" if n.startswith("CYRILLIC") else "o"
    if cat == "Mn" or cat == "Mc":
        return "m"
    if cat == "Cf":
        return "f"
    return "n" if cat[0] == "Z" else "e" if o >= 0x1F000 else "s"


def cost(s: str) -> float:
    """How implausible the characters of ``s`` are where they stand."""
    total, prev, pc = 0.0, "p", " "
    n = len(s)
    for i, c in enumerate(s):
        k = _kind(c) if c > "\x7f" or c < " " else "a" if c.isalpha() else "d" if c.isdigit() else "p"
        if k not in "adp":
            nk = _kind(s[i + 1]) if i + 1 < n else "p"
            beside = prev in "altrCGcsf" or nk in "altrCGcsf"
            if k == "t":
                pass
            elif k == "l":
                if c.isupper() and pc.islower():
                    total += 2.0
                if c in _TRAILERS and pc in "ÃÄÅÂÆË":
                    total += 2.5
                if nk in "sq" and s[i + 1] not in "’”“»…—–" or nk in "cnf" and i + 1 < n and s[i + 1] not in "\n\r\t":
                    total += 1.5
            elif k == "r":
                total += 2.5
            elif k in "CG":
                total += 0.3
                if prev in "atl" or nk in "atl":
                    total += 2.5
                if c.isupper() and pc.islower():
                    total += 2.0
            elif k == "q":
                total += 0.3
                if prev in "altrCG" and nk in "altrCG" and c not in "’‘":
                    total += 2.5
            elif k == "s":
                total += 0.8
                if prev in "altrCG" or nk in "altrCG":
                    total += 2.0
                if prev in "sqcfn" or nk in "sqcfn":
                    total += 0.5
            elif k == "c":
                total += 7.0
            elif k == "?":
                total += 9.0
            elif k in "fn":
                total += 0.6 + (1.5 if prev in "lCGsq" or nk in "lCGsq" else 0.0)
            elif k == "o":
                total += 0.3 + (2.5 if prev in "atl" or nk in "atl" else 0.0)
            elif k == "m":
                total += 1.2
            elif k == "e":
                total += 0.4
            else:
                total += 0.5
        elif k == "a" and prev == "t" and c.isupper() and pc.islower():
            total += 1.0
        prev, pc = k, c
    if "&" in s:
        total += 0.8 * len(re.findall(r"&(?:#\d{2,6}|#x[0-9a-fA-F]{2,5}|[A-Za-z]{2,8}\d?);", s))
    return total


#: Cost of a move: UTF-8 read wrongly leaves many marks, a single-byte swap could explain anything.
MOVE, RARER, SWAP = 0.1, 0.25, 1.5


GAIN = 2.2
#: States that one search opens at most. Garbled words need two to four and none of the test
#: tables' more than 75; random characters could go on without end. What stops here is reported.
BUDGET = 150
#: A move: the encoding taken back to bytes, and the one they are decoded with.
Swap = tuple[str, str]


def _best_first(s: str, start: float, swaps: bool, price: Callable[[str], float] = cost, settled: float = 0.4, slack: float = 4.0, least: float = 0.0) -> tuple[str, float, tuple[Swap, ...], bool]:
    """Cheapest text by ``price``, its cost, the moves to it, whether ``BUDGET`` stopped the search; a state under ``settled`` or ``slack`` above the start isn't opened.

    ``least`` is the lowest price any text can have. The search ends when no open
    state could still lead to a cheaper text, however deep it has to go for that;
    one that has opened ``BUDGET`` states gives the best so far.
    """
    best, best_cost, best_path = s, start, ()
    heap, seen, order, opened = [(start, 0, s, (), 0.0)], {hash(s)}, 0, 0
    while heap:
        c, _, state, path, spent = heapq.heappop(heap)
        if c < best_cost - 1e-9:
            best, best_cost, best_path = state, c, path
        if least + spent + MOVE >= best_cost or c > start + slack or c < settled + spent:
            continue
        if opened == BUDGET:
            return best, best_cost, best_path, True
        opened += 1
        nexts = [(as_utf8(state, name), (*path, (name, "utf-8")), 0.0 if name == "cp1252" else RARER) for name in AS_UTF8 if _lead(name).search(state)]
        if swaps and all(b == "utf-8" for _, b in path):
            nexts += [(state.translate(_swap_table(a, b)), (*path, (a, b)), SWAP) for a, b in SWAPS]
        if "&" in state or "\\" in state:
            nexts.append((unescaped(state), path, 0.0))
        for x, way, extra in nexts:
            h = hash(x)
            if h not in seen:
                seen.add(h)
                order += 1
                heapq.heappush(heap, (price(x) + spent + MOVE + extra, order, x, way, spent + MOVE + extra))
    return best, best_cost, best_path, False


@short_cache(200_000, 200)
def cheapest(s: str) -> tuple[str, float, tuple[Swap, ...], bool]:
    """``(text, what it gains, moves on the way, whether the search was stopped)`` of the cheapest text reachable from ``s``.

    Moves by UTF-8 leave no choice of letters and are searched first; single-byte
    swaps, which can turn anything into letters, only where those leave half of
    the cost.
    """
    start = cost(s)
    if start < GAIN:
        return s, 0.0, (), False
    best, best_cost, path, stopped = _best_first(s, start, False)
    if best_cost > 0.5 * start and any(_kind(x) in "atl" for x in s):
        best, best_cost, path, stopped = _best_first(s, start, True)
    gain = start - best_cost
    return (best, gain, path, stopped) if best != s and gain >= GAIN else (s, 0.0, (), stopped)


_STRETCH = re.compile(r"[^\n.!?]*(?:[.!?]+(?=\s|$)|[.!?]|\n|$)")
_SUSPECT = re.compile(SUSPECT)
_PART = re.compile(r"[^ \t\n\r]+")
_WORDS = re.compile(r"[^\W\d_]+")
#: Letters that Latin-1 readers give for the six Turkish letters it lacks.
THORNS = str.maketrans("þýðÞÝÐ", "şığŞİĞ")
_THORN = re.compile(r"[þýðÞÝÐ]")


def stretches(s: str) -> list[str]:
    return [x for x in _STRETCH.findall(s) if x]


def search(s: str) -> tuple[str, bool]:
    """Restored text and whether any part was changed or is lost."""
    return search_told(s)[:2]


def search_told(s: str) -> tuple[str, bool, bool]:
    """Restored text, whether any part was changed or is lost, whether a search was stopped.

    Parts between blanks are searched on their own, the same part once. A move
    that one part proves holds for the rest of its stretch where it does no harm.
    """
    if not _SUSPECT.search(s):
        return s, False, False
    out, hit, stopped = [], LOST in s, False
    for x in stretches(s):
        if _SUSPECT.search(x):
            swaps: list[Swap] = []

            def one(m: re.Match) -> str:
                nonlocal hit, stopped
                w = m[0]
                if not _SUSPECT.search(w):
                    return w
                y, gain, path, cut_off = cheapest(w)
                stopped |= cut_off
                if gain:
                    hit = True
                    swaps.extend(path)
                return y

            y = _PART.sub(one, x)
            for move in dict.fromkeys(swaps):

                def again(m: re.Match, move: Swap = move) -> str:
                    w = m[0]
                    if w not in x or w.isascii():
                        return w
                    if move[1] != "utf-8":
                        z = w.translate(_swap_table(*move))
                    else:
                        z = as_utf8(w, move[0]) if _lead(move[0]).search(w) else w
                    return z if z != w and cost(z) <= cost(w) + 0.5 else w

                y = _PART.sub(again, y)
            x = y
        out.append(x)
    return "".join(out), hit, stopped


def thorn_words(s: str) -> list[str]:
    """Words with thorn letters of the text, each once."""
    return list({w for w in _WORDS.findall(s) if _THORN.search(w)}) if _THORN.search(s) else []


def judge_thorns(s: str, weight: dict[str, float]) -> tuple[str, bool, bool]:
    """The same search over stretches with thorn words, evidence being part of the price.

    ``weight`` says for each word how much more often the corpus writes it with
    the Turkish letters (a logarithm). A state is cheaper by the weights of the
    words it writes so, and dearer where it writes such a word in a third way.
    """
    out, hit, stopped = [], False, False
    for x in stretches(s):
        here = [w for w in _WORDS.findall(x) if _THORN.search(w)] if _THORN.search(x) else []
        if here:
            at = [(m.start(), m.end(), m[0], m[0].translate(THORNS)) for m in _WORDS.finditer(x) if _THORN.search(m[0])]
            said: set[str] = set()
            at = [(i, j, w, t) for i, j, w, t in at if not (w in said or said.add(w))]

            def price(y: str, at: list = at, n: int = len(x)) -> float:
                if len(y) != n:
                    return cost(y) + len(at)
                return cost(y) - sum(weight.get(w, 0.0) if y[i:j] == t else 0.0 if y[i:j] == w else -1.0 for i, j, w, t in at)

            # No state can gain more than this; what a swap costs is more in most stretches.
            most = cost(x) + sum(max(0.0, weight.get(w, 0.0)) for _, _, w, _ in at)
            y, _, path, cut_off = _best_first(x, price(x), True, price, settled=-1e9, slack=0.0, least=cost(x) - most) if most > MOVE + SWAP else (x, 0.0, (), False)
            stopped |= cut_off
            if path and y != x:
                hit, x = True, y
        out.append(x)
    return "".join(out), hit, stopped


#: Words with letters that thorn letters are confused with, or thorn letters themselves.
_WEIGHED = re.compile(r"(?<![^\W\d_])[^\W\d_þýðÞÝÐşığŞİĞ]*+[þýðÞÝÐşığŞİĞ][^\W\d_]*+")


def repaired(df: DataFrame, text: str, key: list[str]) -> DataFrame:
    """``key`` columns, ``restored``, ``affected`` and ``stopped`` of the rows with something to judge.

    ``affected`` is true where a stretch was wrongly decoded, restorable or not;
    ``restored`` is the text as far as nothing was lost; ``stopped`` tells that a
    search in the text hit ``BUDGET``. Texts in which the search neither changes nor
    misses anything and no thorn letters stand give no row, nor do null and empty
    texts: they aren't affected. Repeated rows are judged alike, length is
    unbounded, an empty table gives an empty one.
    """
    keep = F.struct(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(key)]).alias("keep")
    rows = spread(df.select(keep, F.col(f"`{text}`").alias("text")).where(F.length("text") > 0))
    kind = rows.schema["keep"].dataType.simpleString()

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, out = [], []
            for k, t in enumerate(b.column(1).to_pylist()):
                if _SUSPECT.search(t):
                    fixed, hit, stopped = search_told(t)
                    thorns = thorn_words(fixed)
                    if hit or thorns or stopped:
                        at.append(k)
                        out.append((fixed, hit, stopped, thorns))
            kinds = (pa.string(), pa.bool_(), pa.bool_(), pa.list_(pa.string()))
            columns = [pa.array([o[i] for o in out], kind) for i, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), *columns], names=["keep", "fixed", "hit", "stopped", "thorns"])

    done = cut(rows.mapInArrow(look, f"keep {kind}, fixed string, hit boolean, stopped boolean, thorns array<string>"))
    own = [F.col("keep").getField(f"k{i}").alias(c) for i, c in enumerate(key)]
    doubtful = done.where(F.size("thorns") > 0)
    if doubtful.isEmpty():
        return done.select(*own, F.col("fixed").alias("restored"), F.col("hit").alias("affected"), "stopped")

    # Evidence for thorn letters: how often the corpus writes a word either way.
    asked = doubtful.select(F.explode("thorns").alias("found")).distinct()
    asked = asked.withColumn("turkish", F.translate("found", "þýðÞÝÐ", "şığŞİĞ"))
    wanted = asked.select(F.explode(F.array("found", "turkish")).alias("w")).distinct()

    def weigh(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"h": b["h"], "ws": [_WEIGHED.findall(t) for t in b["text"]]})

    # Copies of a text are folded before the shuffle, so a hot one is a row per task.
    said = rows.select(F.xxhash64("text", F.length("text")).alias("h"), "text").mapInPandas(weigh, "h bigint, ws array<string>")
    said = said.groupBy("h").agg(F.first("ws").alias("ws"), F.count("*").alias("copies")).select(F.explode("ws").alias("w"), "copies")
    # Counted before the join, so a word is shuffled once per task and not once per place.
    counts = said.groupBy("w").agg(F.count("*").alias("n"), F.sum("copies").alias("m")).join(wanted, "w", "left_semi")

    def odds(turkish: str, found: str) -> Column:
        return F.log((F.coalesce(turkish, F.lit(0)) + 1.0) / (F.coalesce(found, F.lit(0)) + 1.0))

    # Over distinct texts, so copies of a garbled text can't outvote the correct spelling;
    # over all rows where that says more, as copies of a correct text are evidence too.
    weighed = (
        asked.join(counts.select(F.col("w").alias("found"), F.col("n").alias("nf"), F.col("m").alias("mf")), "found", "left")
        .join(counts.select(F.col("w").alias("turkish"), F.col("n").alias("nt"), F.col("m").alias("mt")), "turkish", "left")
        .select("found", F.greatest(odds("nt", "nf"), odds("mt", "mf")).alias("weight"))
    )
    with_key = doubtful.withColumn("h", F.md5("fixed"))
    proof = (
        with_key.select("h", F.explode("thorns").alias("found"))
        .distinct()
        .join(weighed, "found")
        .groupBy("h")
        .agg(F.map_from_entries(F.collect_list(F.struct("found", "weight"))).alias("weights"))
    )

    @F.pandas_udf("fixed string, thorn boolean, stopped boolean")
    def settle(fixed: pd.Series, weights: pd.Series) -> pd.DataFrame:
        got = [judge_thorns(s, dict(w)) if w else (s, False, False) for s, w in zip(fixed, weights)]
        return pd.DataFrame(got, columns=["fixed", "thorn", "stopped"])

    settled = with_key.join(proof, "h", "left").withColumn("s", settle("fixed", "weights"))
    judged = settled.select("keep", F.col("s.fixed").alias("fixed"), (F.col("hit") | F.col("s.thorn")).alias("hit"), (F.col("stopped") | F.col("s.stopped")).alias("stopped"))
    every = done.where(F.size("thorns") == 0).select("keep", "fixed", "hit", "stopped").unionByName(judged)
    return every.select(*own, F.col("fixed").alias("restored"), F.col("hit").alias("affected"), "stopped")
