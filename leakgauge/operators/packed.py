"""Several values packed in one text field: one row per value, place kept.

The notation of each field is recognised first. Lists that carry their own
quoting (JSON, Python and NumPy literals, encoded any number of times) and
lettered lists split without doubt; their values, with their counts, form the
dictionary of known whole values. All other fields are bare text with delimiters
that may also stand inside values. Those are cut by dictionary: an Aho-Corasick
automaton over the known values finds every occurrence, and dynamic programming
picks the cover of the field with the fewest doubts (a known value costs the less
the more often it is known), so that delimiters inside known values stay.

The dictionary is dealt out in shards by the first word of its values; a field
visits the shards of the words that its pieces begin with. Shards and fields share
one shuffle: in each partition a shard's values come first and build its automaton,
then its fields stream by in batches. Nothing is broadcast or collected.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import count, product

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leakgauge.functions.cache import short_cache
from leakgauge.session import cut, spread

_ESCAPE = re.compile(r"\\(u[0-9a-fA-F]{4}|x[0-9a-fA-F]{2}|.)", re.S)
_PLAIN = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f"}
_CLOSER = {"[": "]", "(": ")", "{": "}"}
_DELIM = re.compile(r"\r\n|[\n\r\t|;,•¦、]| [/·] ")
#: Delimiters that stand before each value, the first one too.
_BULLETS = ("•", " · ")
_QUOTES = {'"': '"', "'": "'", "“": "”“", "„": "“”", "«": "»", "‘": "’", "‹": "›", "`": "`"}
_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_MARK = re.compile(r"(?:^|(?<=[\s;|,/]))\(?([A-Za-z]{1,3}|\d+)(\)|\.|:|-|\])")


def _labels(numbers: bool) -> Iterator[str]:
    """1, 2, 3, ... or A to Z, AA, AB, ... without end."""
    if numbers:
        yield from map(str, count(1))
    for n in count(1):
        yield from ("".join(x) for x in product(_LETTERS, repeat=n))


def _unescape(s: str) -> str:
    def one(m: re.Match) -> str:
        x = m[1]
        if len(x) > 1:
            return chr(int(x[1:], 16))
        return _PLAIN.get(x, x)

    if "\\" not in s:
        return s
    out = _ESCAPE.sub(one, s)
    if _SURROGATE.search(out):  # pairs written as two escapes
        out = out.encode("utf-16", "surrogatepass").decode("utf-16", "replace")
    return out


_SURROGATE = re.compile("[\ud800-\udfff]")
_REST = {q: re.compile(rf"((?:[^\\{q}]|\\.)*){q}", re.S) for q in "\"'"}


def _literal(s: str, at: int) -> tuple[str, int] | None:
    """The quoted literal that begins at ``at`` and the place after it."""
    m = _REST[s[at]].match(s, at + 1)
    return (_unescape(m[1]), m.end()) if m else None


def _quoted_list(s: str) -> list[str] | None:
    """Items of a bracketed list in which every item is a quoted literal."""
    close, items, i, n = _CLOSER[s[0]], [], 1, len(s)
    while True:
        while i < n and (s[i].isspace() or s[i] == ","):
            i += 1
        if i >= n:
            return None
        if s[i] == close:
            return items if not s[i + 1 :].strip() else None
        if s[i] not in "\"'" or (got := _literal(s, i)) is None:
            return None
        items.append(got[0])
        i = got[1]
        rest = s[i:].lstrip()
        if rest and rest[0] not in ",\"'" + close:
            return None


def _lettered(s: str) -> list[str] | None:
    """Values after option marks that run A, B, C or 1, 2, 3 in one style."""
    marks = [(m.start(), m.end(), m[1].upper(), m[2]) for m in _MARK.finditer(s)]
    if not marks or s[: marks[0][0]].strip():
        return None
    style, run = marks[0][3], []
    if marks[0][2] not in ("A", "1"):
        return None
    labels = _labels(marks[0][2] == "1")
    wanted = next(labels)
    for m in marks:
        if m[2] == wanted and m[3] == style:
            run.append(m)
            wanted = next(labels)
    if len(run) < 2:
        return None
    ends = [m[0] for m in run[1:]] + [len(s)]
    out = [s[m[1] : e].strip() for m, e in zip(run, ends)]
    last = len(out) - 1
    for sep in ";|,/":  # a delimiter that stands before every further mark is none of a value
        if all(v.endswith(sep) for v in out[:last]):
            out = [v[:-1].rstrip() if v.endswith(sep) else v for v in out]
            break
    return out


_OPTION = re.compile(r"\s*\(?([A-Za-z]{1,3})(?:\)|\.|:|-)\s*(.*)$", re.S)


def _strip_marks(values: list[str]) -> list[str]:
    """Option letters go where all values carry them in order."""
    if len(values) > 1:
        if not _OPTION.match(values[0]):
            return values
        got = [_OPTION.match(v) for v in values]
        if all(m and m[1].upper() == c for m, c in zip(got, _labels(False))):
            return [m[2] for m in got]
    return values


def _bare_value(v: str) -> str:
    v = v.strip()
    while len(v) > 1 and v[0] == v[-1] and v[0] in "\"'" and v[0] not in v[1:-1].replace(v[0] * 2, ""):
        v = v[1:-1].replace(v[0] * 2, v[0]).strip()
    if len(v) > 1 and v[0] in "“„«‘‹" and v[-1] in _QUOTES[v[0]] and not any(c in v[1:-1] for c in _QUOTES[v[0]] + v[0]):
        v = v[1:-1].strip()
    return v


def parse(text: str | None) -> tuple[str, list[str] | None]:
    """``(kind, values)``: empty, list, letter or single; bare without values.

    For a bare field the text itself (without enclosing brackets) is returned as
    the only value; ``segment`` cuts it. Each level of encoding makes the text
    shorter, so any number of them is undone.
    """
    s = (text or "").strip().lstrip("\ufeff")
    if not s:
        return "empty", []
    if s[0] in "\"'" and s[-1] == s[0] and (got := _literal(s, 0)) and got[1] == len(s) and got[0].lstrip()[:1] in ("[", "(", '"', "'", "{"):
        return parse(got[0])
    if s[:3] == '"""' and s[-1] == '"' and s[1:-1].replace('""', '"').lstrip()[:2] in ('"[', '["'):
        return parse(s[1:-1].replace('""', '"'))
    if s[0] == '"' and s[-1] == '"' and s[1:2] in "[(" and s[1:-1].rstrip()[-1:] == _CLOSER[s[1]]:
        return parse(s[1:-1].replace('""', '"'))
    if s[0] in _CLOSER and s[-1] == _CLOSER[s[0]]:
        if not s[1:-1].strip():
            return "empty", []
        got = _quoted_list(s)
        if got is not None:
            if len(got) == 1 and got[0].strip()[:1] in ("[", "(", '"'):
                kind, values = parse(got[0])
                if kind == "list":
                    return kind, values
            return "list", [_bare_value(v) for v in _strip_marks(got)]
        if s[0] == "[" or s[0] == "(" and s.count("(") - s.count(")") == 0 and ")" not in s[1:-1].split("(")[0]:
            s = s[1:-1].strip()
    got = _lettered(s)
    if got is not None:
        return "letter", [_bare_value(v) for v in got]
    return "bare", [s]


_STOP = re.compile("[\"'“„«‘‹`]|" + _DELIM.pattern)
_SPACED = re.compile(r",\s")
_BLANKS = re.compile(r"[ \xa0]*")


def pieces(s: str) -> list[tuple[int, int, str, bool]]:
    """Stretches between delimiters: start, end, delimiter behind, quoted as a whole."""
    out, i, n = [], 0, len(s)
    start, quoted = 0, False
    spaced = bool(_SPACED.search(s))
    while m := _STOP.search(s, i):
        i = m.start()
        if s[i] in _QUOTES:
            j = -1
            if not s[start:i].strip():
                q, j = s[i], i + 1
                while (j := min((x for c in _QUOTES[q] if (x := s.find(c, j)) >= 0), default=-1)) >= 0:
                    if s[j + 1 : j + 2] == q and q == '"':
                        j += 2
                        continue
                    after = _BLANKS.match(s, j + 1).end()
                    if after >= n or _DELIM.match(s, after) or (after > j + 1 and _DELIM.match(s, after - 1)):
                        quoted = True
                        break
                    if q != '"':
                        j = -1
                        break
                    j += 1
            i = j + 1 if j >= 0 else i + 1
        elif m[0] == "," and spaced and s[i - 1 : i].isdigit() and s[i + 1 : i + 2].isdigit():
            i += 1  # a decimal comma, as the separating ones are followed by a blank
        else:
            out.append((start, i, m[0], quoted))
            start, quoted, i = m.end(), False, m.end()
    out.append((start, n, "", quoted))
    return out


_JOINED = re.compile(r"\w+ (?:ve|veya|ile|and|or|und|et|y|e) \w+$")


def _known_cost(n: float) -> float:
    """Cost of a known value by how often it is known."""
    return 0.05 + 0.45 / (1.0 + n)


def _segment(s: str, ps: list, spans: dict[tuple[int, int], float], follow: set[str], seps: set[str]) -> tuple[float, list[tuple[int, int]]]:
    """Cheapest cover of the pieces, cut only at delimiters of ``seps``; ``spans`` has the costs of known values."""
    n = len(ps)
    covered = set()  # delimiters that stand inside a known value
    for a, b in spans:
        covered.update(range(a, b))
    first_upper = s.lstrip()[:1].isupper()
    best: list[tuple[float, int]] = [(0.0, 0)] + [(1e18, 0)] * n
    reach = 1
    for b in range(n):
        if ps[b][2] == "" or ps[b][2] not in seps:
            reach += 1
    for b in range(1, n + 1):
        if b < n and (ps[b - 1][2] not in seps):
            continue
        inner = 0.0
        for a in range(b - 1, -1, -1):
            if a < b - 1:
                d, nxt = ps[a][2], s[ps[a + 1][0] : ps[a + 1][1]].split()
                if d in seps:
                    word = nxt[0] if nxt else ""
                    inner += 0.0 if a in covered else 0.2 if word in follow else 4.0
            if a and ps[a - 1][2] not in seps:
                continue
            if best[a][0] > 1e17:
                continue
            v = s[ps[a][0] : ps[b - 1][1]].strip()
            if a == b - 1 and ps[a][3] or (a, b - 1) in spans:
                cost = spans.get((a, b - 1), 0.05)
            elif not v:
                cost = 0.9 + inner
            else:
                cost = 1.0 + inner
                word = v.split()[0]
                if a and (word in follow):
                    cost += 3.0
                if a and ps[a - 1][2] == "," and first_upper and word[:1].islower():
                    cost += 1.5
                if b - 1 > a and inner and all(q[2] == "," and not q[3] for q in ps[a : b - 1]) and _JOINED.search(v) and len(v.split()) == len(ps[a:b]) + 2:
                    cost = 1.0  # one enumeration, as in "x, y and z"
            if best[a][0] + cost < best[b][0] - 1e-9:
                best[b] = (best[a][0] + cost, a)
            if inner > 40 and b - a > reach:
                break
    cover, b = [], n
    while b:
        a = best[b][1]
        cover.append((a, b))
        b = a
    return best[n][0], cover[::-1]


def known_spans(s: str, automaton, ps: list | None = None) -> list[tuple[int, int, int]]:
    """First piece, last piece and count of the known values that stand in a bare field as whole pieces."""
    ps = ps or pieces(s)
    starts = {p[1] - len(s[p[0] : p[1]].lstrip()): k for k, p in enumerate(ps)}
    ends = {p[0] + len(s[p[0] : p[1]].rstrip()): k for k, p in enumerate(ps)}
    out = []
    for end, (value, n) in automaton.iter(s):
        a, b = starts.get(end + 1 - len(value)), ends.get(end + 1)
        if a is not None and b is not None and a <= b:
            out.append((a, b, n))
    return out


def segment(s: str, follow: set[str] = frozenset(), spans: dict[tuple[int, int], float] | None = None, comma_separates: bool = True) -> list[str]:
    """Cut one bare field.

    ``spans``: costs of known values by first and last piece; ``follow``: words
    that only continue values. With ``comma_separates`` each comma outside quotes
    separates where nothing else can; without it known values keep theirs there too.
    """
    ps, spans = pieces(s), spans or {}
    strong = {p[2] for p in ps if p[2]} - {","}
    cover = [(0, len(ps))]
    if strong and not follow and all(x == y for x, y in spans):  # nothing speaks for keeping a delimiter
        at = [0, *(k + 1 for k, p in enumerate(ps) if p[2] in strong), len(ps)]
        cover = list(zip(at, at[1:]))
    elif strong:
        _, cover = _segment(s, ps, spans, follow, strong)
    if len(cover) < 2:
        cover = [(k, k + 1) for k in range(len(ps))] if comma_separates and not strong else _segment(s, ps, {x: c for x, c in spans.items() if not comma_separates or not any(ps[k][2] == "," for k in range(*x))}, follow, {","})[1]
    out = []
    for k, (a, b) in enumerate(cover):
        v = s[ps[a][0] : ps[b - 1][1]]
        if not v.strip() and len(cover) > 1 and (k == len(cover) - 1 or k == 0 and ps[0][2] in _BULLETS):
            continue  # a delimiter behind the last value adds none, nor does a bullet before the first
        out.append(_bare_value(v))
    return _strip_marks(out)


@short_cache(50_000, 1_000)
def _parsed(text: str) -> tuple[str, tuple[str, ...]]:
    kind, values = parse(text)
    return kind, tuple(values)


_FIRST = re.compile(r"[^\s;|,/•¦、·]+")
_BEHIND = re.compile(r"[;|,/\t\n•¦、] ?(\S+)")


def first_word(s: str, start: int = 0, end: int | None = None) -> str:
    """The word that a value or a piece of a field begins with; it names the shard."""
    m = _FIRST.search(s, start, len(s) if end is None else end)
    return m[0] if m else ""


#: Kinds of dictionary rows: a value, a word that begins values, a word behind a delimiter inside them.
VALUE, BEGINS, CONTINUES = 0, 1, 2
#: Dictionary rows of a shard, about.
SHARD_VALUES = 50_000
#: Partitions that the fields of one shard are dealt out to; each builds the shard's automaton.
SALTS = 2


def split_packed(df: DataFrame, field: str, out_pos: str = "pos", out_val: str = "val", comma_separates: bool = True) -> DataFrame:
    """One row per packed value, with all other columns of ``df`` and no ``field``.

    ``out_pos`` counts from 0. Null, blank and empty-list fields give no row; an
    empty value between others keeps its place; repeated rows are split alike;
    an empty table gives an empty table. Other columns may have any name: the
    operator's own work happens in one struct column beside them.
    ``comma_separates`` says whether a comma outside quotes always separates where
    nothing else in the field does.
    """
    others = [c for c in df.columns if c != field]
    keep = F.struct(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(others)]) if others else F.struct(F.lit(1).alias("k0"))
    rows = spread(df.select(keep.alias("keep"), F.col(f"`{field}`").alias("text")).where(F.length(F.trim("text")) > 0))
    kind = rows.schema["keep"].dataType.simpleString()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Fields by notation, and the dictionary's counts of the batch; what is kept beside a field isn't touched."""
        for b in batches:
            words: Counter[tuple[int, str]] = Counter()
            at, vals, bare, delims = [], [], [], []
            for k, t in enumerate(b.column(1).to_pylist()):
                how, values = _parsed(t)
                if how == "empty":
                    continue
                at.append(k)
                if how == "bare":
                    vals.append(None)
                    bare.append(values[0])
                    delims.append(sorted({p[2] for p in pieces(values[0])} - {""}))
                else:
                    vals.append(values)
                    bare.append(None)
                    delims.append(None)
                    for v in filter(None, values):
                        words[VALUE, v] += 1
            for (_, v), n in list(words.items()):
                words[BEGINS, first_word(v)] += n
                for w in {first_word(x) for x in _BEHIND.findall(v)} - {""}:
                    words[CONTINUES, w] += n
            none, rows_ = [None] * len(words), [None] * len(at)
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0).take(pa.array(at + none, pa.int64())), pa.array(vals + none, pa.list_(pa.string())), pa.array(bare + none, pa.string()), pa.array(delims + none, pa.list_(pa.string())),
                    pa.array(rows_ + [k for k, _ in words], pa.int32()), pa.array(rows_ + [w for _, w in words], pa.string()), pa.array(rows_ + list(words.values()), pa.int64()), pa.array(rows_ + [first_word(w) for _, w in words], pa.string()),
                ],
                names=["keep", "vals", "bare", "delims", "kind", "word", "n", "first"],
            )

    looked = cut(rows.mapInArrow(read, f"keep {kind}, vals array<string>, bare string, delims array<string>, kind int, word string, n long, first string"))
    sure = looked.where("vals is not null").select("keep", "vals")
    bare = looked.where("bare is not null").select("keep", F.col("bare").alias("text"), "delims")
    entries = looked.where("word is not null").groupBy("kind", "word", "first").agg(F.sum("n").alias("n"))

    # Only delimiters that stand inside known values leave a choice. They are a handful of signs.
    signs = [";", "|", "/", "\t", "\n", ",", "•", "¦", "、", "·"]
    values = looked.where((F.col("kind") == VALUE) & F.col("word").rlike(r"[;|/\t\n,•¦、·]"))
    seen = values.agg(*[F.coalesce(F.bool_or(F.contains("word", F.lit(c))), F.lit(False)).alias(f"s{k}") for k, c in enumerate(signs)]).first()
    held = {c for k, c in enumerate(signs) if seen[f"s{k}"]}
    free = [d for d in (";", "|", "\t", "\n", "\r\n", "\r", ",", " / ", "•", "¦", "、", " · ") if d.strip(" ") in held or d.strip() == "" and "\n" in held]
    doubt = F.arrays_overlap("delims", F.array(*map(F.lit, free))) if free else F.lit(False)
    if comma_separates:  # where only commas can separate, no known value has a say
        doubt = doubt & (F.array_remove("delims", ",") != F.array().cast("array<string>"))

    @F.pandas_udf("array<string>")
    def plainly(s: pd.Series) -> pd.Series:
        return s.map(lambda x: segment(x, comma_separates=comma_separates))

    done = sure.unionByName(bare.where(~doubt).select("keep", plainly("text").alias("vals")))
    if free:
        done = done.unionByName(_by_dictionary(bare.where(doubt).select("keep", "text"), entries, comma_separates))
    flat = done.select("keep", F.posexplode("vals").alias("lg_pos", "lg_val"))
    own = [F.col("keep").getField(f"k{i}").alias(c) for i, c in enumerate(others) if c not in (out_pos, out_val)]
    return flat.select(*own, F.col("lg_pos").cast("int").alias(out_pos), F.col("lg_val").alias(out_val))


def _by_dictionary(bare: DataFrame, entries: DataFrame, comma_separates: bool) -> DataFrame:
    """``keep, vals`` of bare fields ``keep, text``, cut with the dictionary ``kind, word, first, n``."""
    spark = bare.sparkSession
    parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    n_shards = max(parts, entries.count() // SHARD_VALUES + 1)
    kind = bare.schema["keep"].dataType.simpleString()

    def shard(word: Column) -> Column:
        return F.pmod(F.xxhash64(word), F.lit(n_shards)).cast("int")

    @F.pandas_udf("array<string>")
    def begins(s: pd.Series) -> pd.Series:
        return s.map(lambda x: list(dict.fromkeys(first_word(x, p[0], p[1]) for p in pieces(x))))

    nothing = F.lit(None)
    values = entries.select(
        shard(F.col("first")).alias("shard"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"), "kind", "word", "n",
        nothing.cast("bigint").alias("rid"), nothing.cast(kind).alias("keep"), nothing.cast("string").alias("text"),
    )
    fields = bare.withColumn("rid", F.monotonically_increasing_id())
    # A shard is visited once; the field itself travels with its first visit.
    visits = fields.select("rid", "keep", "text", F.explode(F.array_distinct(F.transform(begins("text"), shard))).alias("shard"))
    visits = visits.select("shard", F.pmod("rid", F.lit(SALTS)).cast("int").alias("salt"), nothing.cast("int").alias("kind"), nothing.cast("string").alias("word"), nothing.cast("bigint").alias("n"), "rid", "keep", "text")

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Known values in the fields of each shard; its dictionary comes before them."""
        import ahocorasick

        now, auto, follow, starts, ready = None, None, set(), set(), False
        for b in batches:
            at, rids, spans, conts = [], [], [], []
            columns = (b.column(b.schema.get_field_index(c)).to_pylist() for c in ("shard", "salt", "kind", "word", "n", "rid", "text"))
            for k, (sh, salt, how, word, n, rid, text) in enumerate(zip(*columns)):
                if (sh, salt) != now:
                    now, auto, follow, starts, ready = (sh, salt), ahocorasick.Automaton(), set(), set(), False
                if text is None:
                    if how == VALUE:
                        auto.add_word(word, (word, n))
                    else:
                        (starts if how == BEGINS else follow).add(word)
                    continue
                if not ready:
                    ready = True
                    if len(auto):
                        auto.make_automaton()
                ps = pieces(text)
                at.append(k)
                rids.append(rid)
                spans.append(known_spans(text, auto, ps) if len(auto) else [])
                conts.append([w for w in {first_word(text, p[0], p[1]) for p in ps} if w in follow and w not in starts] if follow else [])
            if at:
                some = pa.array(at, pa.int64())
                kept, texts = (b.column(b.schema.get_field_index(c)).take(some) for c in ("keep", "text"))
                yield pa.RecordBatch.from_arrays([pa.array(rids, pa.int64()), kept, texts, pa.array(spans, pa.list_(pa.list_(pa.int64()))), pa.array(conts, pa.list_(pa.string()))], names=["rid", "keep", "text", "spans", "conts"])

    both = values.unionByName(visits).repartition(parts, "shard", "salt").sortWithinPartitions("shard", "salt", F.col("kind").isNull())
    hits = both.mapInArrow(match, f"rid long, keep {kind}, text string, spans array<array<bigint>>, conts array<string>")
    each = hits.groupBy("rid").agg(F.first("keep").alias("keep"), F.first("text").alias("text"), F.flatten(F.collect_list("spans")).alias("spans"), F.flatten(F.collect_list("conts")).alias("conts"))

    @F.pandas_udf("array<string>")
    def cover(text: pd.Series, spans: pd.Series, conts: pd.Series) -> pd.Series:
        return pd.Series([segment(t, set(c), {(int(a), int(b)): _known_cost(int(n)) for a, b, n in x}, comma_separates) for t, x, c in zip(text, spans, conts)], dtype=object)

    return each.select("keep", cover("text", "spans", "conts").alias("vals"))
