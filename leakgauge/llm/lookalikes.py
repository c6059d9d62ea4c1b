"""One consistent form for text that looks the same but differs in its characters.

A text's odd tokens, as they stand (with zero-width characters, full-width forms and
letters of other alphabets in them), are looked up in tries of the corpus's own
vocabulary. The traversal is a weighted edit automaton: ignorable characters,
widths, look-alike letters and marks that look alike cost nothing, a foreign mark on
a look-alike letter costs a little, marks elsewhere and other letters more; the
cheapest word within ``LIMIT`` is the token's spelling, the more frequent one of
equals. Tokens that no trie word matches, and all that is no token (blanks,
hyphens, signs), are normalised by table.

Vocabulary and odd tokens meet in shards by the beginning of their skeleton, as many
as the vocabulary's size asks for, so no task holds the whole vocabulary and nothing
is broadcast or collected.
"""

from __future__ import annotations

import heapq
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leakgauge.session import cut, spread

# Letters of other alphabets, each before the plain letters it resembles.
RESEMBLES = {
    # Cyrillic
    "а": "a", "в": "b", "е": "e", "ё": "ë", "з": "3", "и": "u", "к": "k", "м": "m", "н": "h", "о": "o",
    "п": "n", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x", "ѕ": "s", "і": "ıi", "ї": "ï", "ј": "j",
    "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ӏ": "l", "ү": "y", "ь": "b", "г": "r",
    "А": "A", "В": "B", "Е": "E", "З": "3", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C",
    "Т": "T", "У": "Y", "Х": "X", "Ѕ": "S", "І": "I", "Ј": "J", "Ӏ": "I", "Һ": "H", "Ԁ": "D", "Ԛ": "Q",
    "Ԝ": "W", "Ү": "Y", "Г": "G", "Ԍ": "G",
    # Greek
    "α": "a", "β": "ß", "γ": "y", "ε": "e", "η": "n", "ι": "ıi", "κ": "k", "μ": "u", "ν": "v", "ο": "o", "ρ": "p",
    "σ": "o", "τ": "t", "υ": "u", "χ": "x", "ω": "w", "ϲ": "c", "ϳ": "j",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O",
    "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "Ϲ": "C", "Ϳ": "J",
    # Armenian
    "ո": "n", "ս": "u", "օ": "o", "հ": "h", "ց": "g", "զ": "q", "յ": "j", "Ս": "U", "Օ": "O", "Լ": "L", "Տ": "S",
    # Latin letters outside the plain alphabets
    "ɑ": "a", "ɡ": "g", "ɩ": "ı", "ʟ": "L", "ѵ": "v", "ᴏ": "o", "ᴜ": "u", "ᴠ": "v", "ᴡ": "w", "ᴢ": "z", "ᴄ": "c",
    "ꜱ": "s", "ɪ": "I", "ǝ": "e", "ƨ": "s", "ƽ": "s", "ɴ": "N", "ʀ": "R", "ʙ": "B", "ʜ": "H", "ĸ": "k", "ȷ": "j",
}
#: Combining marks that look like the mark of a Turkish letter.
MARKS = {"\u0326": "\u0327", "\u0322": "\u0327", "\u0321": "\u0327", "\u030c": "\u0306", "\u0311": "\u0306"}
PLAIN = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZçğıöşüÇĞİÖŞÜâîûÂÎÛ0123456789_")
HYPHENS = frozenset("\u2010\u2011\ufe63\uff0d")
FILLERS = frozenset("\u034f\u115f\u1160\u17b4\u17b5\u180b\u180c\u180d\u180e\u3164\uffa0")
_JOINERS = "\u200c\u200d"
#: A text without a match needs no look at all.
_ODD = re.compile(r"[^\x20-\x7E\n\r\tçğıöşüÇĞİÖŞÜ]")
#: Characters that show nothing, as a class.
_UNSEEN = "\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f\xad\u034f\u061c\u115f\u1160\u17b4\u17b5\u180b-\u180f\u200b-\u200f\u202a-\u202e\u2060-\u206f\u3164\ufe00-\ufe0f\ufeff\uffa0\ufff9-\ufffb\U000e0000-\U000e007f\U000e0100-\U000e01ef"
_IS_UNSEEN = re.compile(f"[{_UNSEEN}]")
#: Tokens as they stand: letters, digits, marks and what shows nothing among them.
_RAW = re.compile(f"(?:[^\\W_]|[\u0300-\u036f{_UNSEEN}])+")
#: Words of plain letters that stand free.
_WORD = re.compile(r"(?<![^\s(\[{*\-,.:;])[A-Za-zçğıöşüÇĞİÖŞÜ]+(?![^\s)\]}*\-,.:;?!])")


def _emoji(c: str) -> bool:
    o = ord(c)
    return unicodedata.category(c) == "So" or 0x1F000 <= o <= 0x1FAFF or o in (0x20E3, 0xFE0F, 0x23, 0x2A) or 0x30 <= o <= 0x39


def _joins(c: str) -> bool:
    """Letters of scripts in which joiners are part of the spelling."""
    return unicodedata.category(c)[0] in "LM" and 0x0590 <= ord(c) <= 0x1BFF and not 0x10A0 <= ord(c) <= 0x11FF


def ignorable(s: str, i: int) -> bool:
    """Whether the character at ``i`` shows nothing and belongs to nothing beside it."""
    c = s[i]
    if c in "\n\r\t":
        return False
    before, after = s[i - 1 : i], s[i + 1 : i + 2]
    if 0xFE00 <= ord(c) <= 0xFE0F or 0xE0100 <= ord(c) <= 0xE01EF:
        return not (before and _emoji(before) and not before.isdigit() or before.isdigit() and after == "\u20e3" or before and ord(before) >= 0x2E80)
    if 0xE0020 <= ord(c) <= 0xE007F:
        return "\U0001f3f4" not in s[max(0, i - 8) : i]
    if c in FILLERS:
        return True
    if unicodedata.category(c) not in ("Cf", "Cc"):
        return False
    if c in _JOINERS and before and after:
        if c == "\u200d" and _emoji(before) and _emoji(after) and not (before + after).isascii() and not before.isdigit() and not after.isdigit():
            return False
        if _joins(before) and _joins(after):
            return False
    if 0x0600 <= ord(c) <= 0x0605 or ord(c) in (0x06DD, 0x070F):
        return False
    return True


def letter_form(c: str) -> str:
    """Plain width and form of one character; signs that look different stay."""
    if c in HYPHENS:
        return "-"
    cat = unicodedata.category(c)
    if cat in ("Zs", "Zl", "Zp"):
        return " "
    d = unicodedata.decomposition(c)
    if d.startswith("<"):
        tag = d[1 : d.index(">")]
        if tag in ("wide", "narrow", "font") or tag in ("compat", "noBreak", "initial", "medial", "final", "isolated") and (cat[0] == "L" or cat == "Nl") and ord(c) < 0xFB50:
            return unicodedata.normalize("NFKC", c)
    return c


def prepare(s: str) -> str:
    """Ignorables out, blanks, hyphens, width and forms plain, letters composed."""
    kept = "".join(letter_form(c) for i, c in enumerate(s) if c < "\x7f" and c >= " " or not ignorable(s, i))
    out = unicodedata.normalize("NFC", kept)
    return re.sub("([iıіjι])\u0307+", lambda m: {"ı": "i"}.get(m[1], m[1]), out)


_TOKEN = re.compile(r"[^\W_](?:[̀-ͯ]|[^\W_])*")


def _latin(c: str) -> bool:
    return c.isalpha() and unicodedata.name(c, "").startswith("LATIN")


def choices(c: str) -> str:
    """Letters that one decomposed character may stand for, the table's choice first."""
    return RESEMBLES.get(c, c)


def odd_tokens(s: str) -> list[str]:
    """Distinct raw tokens with letters that have letters of other forms, foreign look-alikes or unseen characters."""

    def odd(t: str) -> bool:
        if PLAIN.issuperset(t) or not any(c.isalpha() for c in t):
            return False
        return any(x in RESEMBLES or x in MARKS or _IS_UNSEEN.match(x) or letter_form(x) != x or x == "\u0307" for x in unicodedata.normalize("NFD", t)) or unicodedata.normalize("NFC", t) != t

    return [t for t in dict.fromkeys(_RAW.findall(s)) if odd(t)]


def by_table(token: str) -> str:
    """Table form of a token: foreign letters beside Latin ones become those they resemble."""
    d = unicodedata.normalize("NFD", token)
    if any(_latin(c) and c not in RESEMBLES for c in d) or any(c.isdigit() for c in d):
        d = "".join(choices(c)[-1] if c in RESEMBLES else MARKS.get(c, c) if unicodedata.normalize("NFC", p + MARKS.get(c, c)) in PLAIN else c for p, c in zip(" " + d, d))
        return re.sub("i\u0307+", "i", unicodedata.normalize("NFC", d))
    return token


def skeleton(token: str) -> str:
    """Equal for every spelling that the automaton may match: plain letters without marks, ignorables left out."""
    d = unicodedata.normalize("NFD", "".join(letter_form(c) for c in token if not _IS_UNSEEN.match(c)))
    d = unicodedata.normalize("NFD", "".join(choices(c)[-1] if c in RESEMBLES else c for c in d))
    return "".join(c for c in d if not unicodedata.combining(c)).replace("ı", "i")


#: Costs of the automaton's edits. Ignorables, widths, look-alikes and twin marks cost nothing.
MARK_ON_LOOKALIKE, MARK, LETTER = 0.2, 0.4, 1.0
#: Most that a spelling may cost.
LIMIT = 0.3


class Trie:
    """Vocabulary words over decomposed characters; leaves hold word and count."""

    def __init__(self) -> None:
        self.root: dict = {}

    def add(self, word: str, n: int) -> None:
        node = self.root
        for c in unicodedata.normalize("NFD", word):
            node = node.setdefault(c, {})
        if n > node.get("", ("", 0))[1]:
            node[""] = (word, n)

    def match(self, token: str, limit: float = LIMIT) -> str | None:
        """Cheapest word within ``limit``; the more frequent one of equals, then the smaller.

        States are (cost, place in the raw token, trie node), opened by cost.
        """
        d = unicodedata.normalize("NFD", token)
        heap, order, found, least = [(0.0, 0, 0, self.root)], 0, [], limit
        done: dict[tuple[int, int], float] = {}
        while heap:
            cost, _, i, node = heapq.heappop(heap)
            if cost > least + 1e-9:
                break
            if done.get((i, id(node)), 1e9) <= cost:
                continue
            done[(i, id(node))] = cost
            steps: list[tuple[float, int, dict]] = []
            if i == len(d):
                if "" in node:
                    found.append(node[""])
                    least = cost
            else:
                c = d[i]
                if c in node:
                    steps.append((0.0, i + 1, node[c]))
                if _IS_UNSEEN.match(c):
                    steps.append((0.0, i + 1, node))
                for x in (*RESEMBLES.get(c, ""), MARKS.get(c)):
                    at = node
                    for y in unicodedata.normalize("NFD", x) if x else ():
                        at = at.get(y) if at is not None else None
                    if x and at is not None:
                        steps.append((0.0, i + 1, at))
                plain = letter_form(c)
                if plain != c:
                    at = node
                    for y in unicodedata.normalize("NFD", plain):
                        at = at.get(y) if at is not None else None
                    if at is not None:
                        steps.append((0.0, i + 1, at))
                if unicodedata.combining(c):
                    on = next((x for x in reversed(d[:i]) if not unicodedata.combining(x) and not _IS_UNSEEN.match(x)), "")
                    free = c == "\u0307" and on in tuple("iјіjι")
                    steps.append((0.0 if free else MARK_ON_LOOKALIKE if on in RESEMBLES else MARK, i + 1, node))
                elif cost + LETTER <= least:
                    steps.append((LETTER, i + 1, node))
                    steps += [(LETTER, i + 1, at) for x, at in node.items() if x and not unicodedata.combining(x) and x != c]
            if cost + MARK <= least:
                steps += [(MARK if unicodedata.combining(x) else LETTER, i, at) for x, at in node.items() if x]
            for more, k, at in steps:
                if cost + more <= least + 1e-9:
                    order += 1
                    heapq.heappush(heap, (cost + more, order, k, at))
        return min(found, key=lambda w: (-w[1], w[0]))[0] if found else None


#: Words of a shard's trie, about.
SHARD_WORDS = 20_000


def canonical_map(tokens: DataFrame, vocabulary: DataFrame, limit: float = LIMIT) -> DataFrame:
    """``token, canon`` of the distinct odd tokens that a word of ``vocabulary(word, n)`` matches."""
    skel = F.pandas_udf(lambda s: s.map(skeleton), T.StringType())
    spark = tokens.sparkSession
    n_shards = max(spark.sparkContext.defaultParallelism, vocabulary.count() // SHARD_WORDS + 1)

    def shard(of: str) -> Column:
        return F.pmod(F.xxhash64(F.substring(skel(of), 1, 3)), F.lit(n_shards)).cast("int").alias("shard")

    left, right = tokens.select(shard("token"), "token"), vocabulary.select(shard("word"), "word", "n")

    def look_up(key: tuple, odd: pd.DataFrame, words: pd.DataFrame) -> pd.DataFrame:
        trie = Trie()
        for w, n in zip(words["word"], words["n"]) if len(odd) else ():
            trie.add(w, int(n))
        got = []
        for t in odd["token"]:
            # A single letter of another script is that script's word.
            lone = len(letters := [c for c in t if not _IS_UNSEEN.match(c)]) < 2 and not any(_latin(c) for c in letters)
            got.append(None if lone else trie.match(t, limit))
        return pd.DataFrame({"token": odd["token"], "canon": pd.Series(got, index=odd.index, dtype=object)}).dropna()

    return left.groupBy("shard").cogroup(right.groupBy("shard")).applyInPandas(look_up, "token string, canon string")


def form(text: str, canon: dict[str, str]) -> str:
    """The consistent form: spellings that the tries settled, all else by table."""
    s = prepare(_RAW.sub(lambda m: canon.get(m[0], m[0]), text))
    return unicodedata.normalize("NFC", _TOKEN.sub(lambda m: m[0] if PLAIN.issuperset(m[0]) else by_table(m[0]), s))


def settled(rows: DataFrame, min_count: int = 2, limit: float = LIMIT) -> DataFrame:
    """``keep, text, fixed, by_trie`` of the rows of ``rows(keep, text)`` with odd characters.

    ``by_trie`` counts the text's odd tokens whose spelling a trie settled,
    ``odd`` all of them. ``min_count`` is the least frequency of a word in the
    vocabulary, which is counted over all texts.
    """
    kind = rows.schema["keep"].dataType.simpleString()
    made = "keep " + kind + ", text string, tokens array<string>, word string, n long"

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Odd texts with their odd tokens, and the batch's words with their counts; ``keep`` isn't touched."""
        for b in batches:
            said: Counter[str] = Counter()
            at, texts, tokens = [], [], []
            for k, t in enumerate(b.column(1).to_pylist()):
                said.update(_WORD.findall(t))
                if _ODD.search(t):
                    at.append(k)
                    texts.append(t)
                    tokens.append(odd_tokens(t))
            none, gap = [None] * len(said), [None] * len(at)
            columns = [pa.array(texts + none, pa.string()), pa.array(tokens + none, pa.list_(pa.string())), pa.array(gap + list(said), pa.string()), pa.array(gap + list(said.values()), pa.int64())]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at + none, pa.int64())), *columns], names=["keep", "text", "tokens", "word", "n"])

    looked = cut(spread(rows.where(F.length("text") > 0)).mapInArrow(look, made))
    words = looked.where("word is not null").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)
    odd = looked.where("text is not null").select("keep", "text", "tokens").withColumn("rid", F.monotonically_increasing_id())
    pairs = odd.select("rid", F.explode("tokens").alias("token"))
    canon = canonical_map(pairs.select("token").distinct(), words, limit)
    maps = pairs.join(canon, "token").groupBy("rid").agg(F.map_from_entries(F.collect_list(F.struct("token", "canon"))).alias("m"))

    @F.pandas_udf(T.StringType())
    def fix(text: pd.Series, m: pd.Series) -> pd.Series:
        return pd.Series([form(t, dict(x) if x else {}) for t, x in zip(text, m)], dtype=object)

    got = odd.join(maps, "rid", "left")
    return got.select("keep", "text", fix("text", "m").alias("fixed"), F.coalesce(F.size("m"), F.lit(0)).alias("by_trie"), F.size("tokens").alias("odd"))


@F.pandas_udf(T.BooleanType())
def _is_odd(text: pd.Series) -> pd.Series:
    return text.map(lambda t: bool(t) and bool(_ODD.search(t)))


def consistent(df: DataFrame, field: str, out: str = "consistent") -> DataFrame:
    """``df`` with ``out``, the consistent form of ``field``; null stays null.

    Null and empty texts and texts of plain characters are their own consistent
    form. All columns and rows stay, whatever their names; ``out`` replaces a column
    of that name. Length is unbounded; an empty table gives an empty table.
    """
    own = [c for c in df.columns if c != out]
    rows = df.select(F.struct(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(own)]).alias("keep"), F.col(f"`{field}`").alias("text"))
    plain = rows.where(~F.coalesce(_is_odd("text"), F.lit(False))).select("keep", F.col("text").alias("fixed"))
    got = plain.unionByName(settled(rows).select("keep", "fixed"))
    return got.select(*[F.col("keep").getField(f"k{i}").alias(c) for i, c in enumerate(own)], F.col("fixed").alias(out))


def found(frames: list[tuple[str, str, DataFrame]], key: str = "line_no") -> DataFrame:
    """``src_table, field_name, key`` of the field values that differ from their form.

    One vocabulary serves all fields, so a spelling is settled alike everywhere.
    """
    rows = None
    for src, field, df in frames:
        keep = F.struct(F.lit(src).alias("src_table"), F.lit(field).alias("field_name"), F.col(f"`{key}`").alias("line_no"))
        one = df.select(keep.alias("keep"), F.col(f"`{field}`").alias("text"))
        rows = one if rows is None else rows.unionByName(one)
    return settled(rows).where("text <> fixed").select("keep.src_table", "keep.field_name", "keep.line_no")
