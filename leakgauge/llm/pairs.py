"""Defective prompt and answer pairs, each with the kind of its defect.

Kinds, the first that applies: ``empty``, ``refusal``, ``copies_question``,
``other_language``, ``truncated``.

Copies are told by compression in both directions: the question is compressed with
the answer as zstandard dictionary (a copy holds it, so little is left) and the
answer with the prompt (a copy is made of it). Both must stay under ``LEFT``; words
beside the copied ones may then still be an answer. Dictionaries name languages
(function words, endings), refusals (who declines, which act, in which language)
and transport errors. A text that doesn't close is whole or broken off by a
terminal-context model: for its last one, two and three words it has counted over
all distinct answers how often texts end there without a mark and how often they
go on, be it by further words or by further letters of the last one.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leakgauge.functions.cache import short_cache
from leakgauge.session import cut

EMPTY, REFUSAL, COPY, LANGUAGE, TRUNCATED = "empty", "refusal", "copies_question", "other_language", "truncated"
#: A pair whose answer awaits the terminal-context model.
ASK = "?"

# Function words of each language, folded.
COMMON = {
    "tr": "ve bir bu su o icin ile degil ise olan olarak ki kadar daha cok her ancak ama fakat veya ya gibi sonra once oldugu olmalidir olur var yok hem hangi hangisi hangileri kac kactir ne neden nasil nedir nerede kim yani cunku diger ayni ayrica yalnizca sadece tum bazi hic icinde arasinda disinda gore dogru yanlis soru cevap yanit lutfen bunu buna bunun bundan sunu onu ben biz sen siz mi mu boyle soyle bugun yarin simdi zaten belki evet hayir en iki uc oyle uzere ragmen dolayi nedenle",
    "en": "the and is are was were of to in that this it be not with for because only when which what so from has have had there other correct right wrong should can does do did they them their he she his her we our would will could may might must on at by an your you its if than then these those who how why where been being or but as about into over under between both each more most some any no yes please here also such out off up",
    "de": "der die das und ist sind nicht eine einen einer einem ein mit fur auf von zu den dem des richtig falsch deshalb andere anderen weil wird wurde werden auch aus es im oder als nur wenn dass daran ich wir sie er ihr sein haben hat kann bei nach vor uber unter durch um am zum zur wie was wer wo noch schon sehr hier diese dieser dieses",
    "fr": "le les et est une un des du que qui dans pour sur pas ne ce cette ces autres avec au aux par deja si en effet la il elle nous vous je on son sa ses leur plus mais ou donc comme tout aussi bien etre sont ete avoir fait faut bonne n d l qu c s j",
    "es": "el los las y es una un del que en por para con no se lo como cuando tambien correcta otra otro otras hay eso esto este esta debe la su sus al pero mas muy ya porque son fue ser ha han yo tu nosotros ellos le les de sin sobre entre hasta desde donde quien si solo demas",
    "pt": "o os as e uma um do da dos das que em no na nos nas por para com nao se como quando tambem correta outra isso deve a ao so porque esta este ele ela eu nos seu sua mas mais muito ja foi ser sao tem ha sem sobre entre ate onde quem pelo pela",
    "it": "il lo gli e una un del della dei delle che in per con non si come quando anche corretta questo questa perche la sono ma piu molto gia stato essere ha hanno io noi loro suo sua di da al alla nel nella sul tra fra dove chi cosa",
    "nl": "de het een en is niet van voor met op dat die zijn omdat ook alleen wordt deze dit ik wij je u hij zij maar als bij naar uit aan door over onder tussen nog al zeer hier daar wat wie waar hoe geen kan moet",
    "pl": "jest nie to sie na w z do ze i a ale oraz dlatego jak co kto gdzie czy tak byl byla sa ten ta te tego tej przez dla od po przed przy tylko juz bardzo moze",
    "is": "er og ad sem ekki um fra var i a thad svar en vid til af med ekki hann hun eg vid thau thessi thetta eru hefur vera",
    "sv": "och att det som en ett pa ar av for med till den inte om har de ett han hon var jag vi ni men eller fran sa nar dar hur vad vem inom mellan mycket ocksa detta denna kan ska blir",
    "da": "og at det som en et pa er af for med til den ikke om har de han hun var jeg vi men eller fra sa nar der hvor hvad hvem mellem meget ogsa dette denne kan skal bliver",
    "fi": "ja on ei se etta han ne tama joka mutta kun niin kuin myos ovat oli olla voi jos vain sen siita mika missa kuka koska tai eli mina me te he hyvin enemman",
    "hu": "a az es egy nem hogy is van ez azt de meg csak mint vagy ha volt lesz mert ami aki ahol nagyon minden",
    "ro": "si este un o nu ca pe la cu de din pentru care sunt mai dar sau daca acest aceasta fost prin intre foarte doar",
    "cs": "je a se na v z do ze to nebo ale jako jsou byl byla bylo pro od po pri jen uz velmi ktery ktera protoze",
    "az": "ve bir bu ucun ile deyil olan kimi daha cox her amma ve ya sonra evvel var yox ne nece bele hansi",
    "id": "dan yang di ke dari ini itu untuk dengan tidak adalah pada dalam akan oleh karena atau juga ada bisa mereka kami kita saya",
}
_LEX: dict[str, dict[str, float]] = {}
for _code, _ws in COMMON.items():
    for _w in set(_ws.split()):
        _LEX.setdefault(_w, {})[_code] = 1.0
for _of in _LEX.values():
    _n = len(_of)
    for _code in _of:
        _of[_code] = 1.0 / _n
# Endings that Turkish inflection gives to longer words, folded.
_ENDINGS = re.compile(r"\w{2,}(?:larin|lerin|lari|leri|larda|lerde|lardan|lerden|iyor|uyor|acak|ecek|arak|erek|mistir|mustur|maktadir|mektedir|lidir|ludur|sidir|tirilir|masi|mesi|inda|inde|unda|unde|acagi|ecegi)$")

NAMES = {
    "tr": r"turkish|turkce\w*|turkisch\w*", "en": r"english|ingilizce\w*|englisch\w*", "de": r"german|almanca\w*|deutsch\w*",
    "fr": r"french|fransizca\w*", "es": r"spanish|ispanyolca\w*", "pt": r"portuguese|portekizce\w*", "it": r"italian|italyanca\w*",
    "ru": r"russian|rusca\w*", "ar": r"arabic|arapca\w*", "is": r"icelandic|izlandaca\w*", "sv": r"swedish|isvecce\w*", "fi": r"finnish|fince\w*",
}
_NAMED = re.compile(rf"\b(?:{'|'.join(NAMES.values())})")
_ASKED = {c: re.compile(rf"(?:\b(?:into|to|in)\s+(?:{n})\b|\b(?:{n})(?:ye|ya|e|a)?\s+(?:cevir|yaz|yanit|cevap|acikla)|cumleyi\s+(?:{n})\s+cevir)") for c, n in NAMES.items()}

# Verbs of asking, folded.
_ASKS = re.compile(r"\b(?:translat(?:e|ion)|render|answer|reply|respond|response|write|explain|summari[sz]e|summary|state|give|say|describe|tell|put|name|define|express|provide|list|use|speak|mean|called|please|cevir\w*|yaz\w*|yanit\w*|cevap\w*|acikla\w*)\b")

# Refusals by language, folded. Each names who declines and the act declined,
# within one sentence; [^.!?] keeps it there.
_ACT_EN = r"(?:help|assist|answer|provide|pick|choose|give|comply|discuss|respond|share|fulfil\w*|complete|continue|engage|offer|support|reply|select|comment|recommend|generate|create|write|do|solve|process|comfortable)"
_TOPIC_TR = r"(?:soru|istek|isteg|talep|taleb|icerik|icerig|konu|yanit|cevap|cevab|yardim|destek|secenek|seceneg|sik|bilgi|yorum|gorus|bunu|buna|bu tur|boyle)"
_NOT_I_TR = r"\w{2,}(?:[ae]m[ae]m|[ae]m[iu]yor(?:um|uz)|[ae]m[ae]y[ae]c[ae][gk]i[mz]|[ae]m[ae]yiz|[mt]m[iu]yor(?:um|uz)|m[iu]yor(?:um|uz)|m[ae]y[ae]c[ae][gk]i[mz])\b"
_THING = r"(?:yanit|cevap|icerik|mesaj|metin|response|answer|content|message|output|text|reply|completion)"
_GONE = r"(?:kaldiril|gizlen|engellen|filtrelen|silin|cikaril|withheld|removed|blocked|filtered|redacted|hidden|suppressed|censored)"
_REFUSES = re.compile(
    # Turkish: first-person negation about the request; a first-person act that is impossible or unfit; refusing outright
    rf"\b{_TOPIC_TR}\w*\b[^.!?]*?\b{_NOT_I_TR}|\b{_NOT_I_TR}[^.!?]*?\b{_TOPIC_TR}"
    r"|\w{2,}m[ae]mi?\b[^.!?]*\b(?:mumkun degil|olanakli degil|uygun degil|uygun olma|dogru olmaz|dogru degil|engel\w*|yasak\w*|izin veril\w*|izin verm\w*|imkansiz)"
    r"|\bredde(?:diyor|derim|tmek|tmeli)\w*|\bbenden (?:\w+ )?(?:istemeyin|isteme|beklemeyin|bekleme|istemeyiniz)\b"
    # English
    rf"|\b(?:i|we)\b(?:'m|'re| am| are)?[^.!?]{{0,40}}?\b(?:can ?not|can't|won't|will not|wouldn't|unable|not able|not allowed|not permitted|not willing|not comfortable|not going|don't feel|do not feel|prefer not|rather not|not in a position)\b[^.!?]*?\b{_ACT_EN}\b"
    rf"|\b(?:i|we)(?:'d| would| must| have to| need to| will)? (?:respectfully |politely )?(?:decline|refuse)\b|\b(?:unable|not able) to {_ACT_EN}\b|(?:isn't|is not|not) something (?:i|we) (?:can|could|will|am able|are able)\b"
    r"|\bask (?:someone|somebody) else\b|\bagainst (?:my|our|the) (?:guidelines?|polic(?:y|ies)|rules|principles|programming)\b|\b(?:beyond|outside) (?:my|our) (?:scope|abilit|capabilit|remit)\w*"
    # German, Dutch, Swedish, Danish, Norwegian
    r"|\b(?:kann|darf|werde|mochte|konnen|will) (?:ich|wir)\b[^.!?]*\b(?:nicht|keine?)\b|\b(?:ich|wir) (?:\w+ )?(?:kann|darf|werde|mochte|konnen|will)\b[^.!?]*\b(?:nicht|keine?n?)\b[^.!?]*(?:antwort|helf|hilf|geb|unterstutz|sag|losen|bearbeit|weiter)|\b(?:ich|wir) (?:lehne|weigere|verweigere)\b"
    r"|\b(?:ik|wij|we) (?:kan|mag|wil|ga|zal|kunnen)\b[^.!?]*\b(?:niet|geen)\b[^.!?]*(?:antwoord|help|geven|voldoen)|\b(?:kan|mag) ik\b[^.!?]*\b(?:niet|geen)\b"
    r"|\b(?:jag|jeg|vi) (?:kan|far|vill|vil|kommer|ma)\b[^.!?]*\b(?:inte|ikke)\b[^.!?]*(?:svar|hjalp|hjelp|hjaelp|bista|besvar)|\b(?:kan|far) (?:jag|jeg)\b[^.!?]*\b(?:inte|ikke)\b"
    # French, Spanish, Portuguese, Italian, Romanian
    r"|\bje (?:ne |n')(?:peux|puis|pourrai|pourrais|suis|souhaite|veux|vais|saurais|dois)\b[^.!?]*(?:repond|aider|aide\b|fourn|donner|assist|traiter|satisf|commenter|mesure)|\bje (?:refuse|decline|dois (?:refuser|decliner))\b"
    r"|\bno (?:puedo|podre|podria|podemos|me es posible|estoy en condiciones|voy a|deseo|debo)\b[^.!?]*(?:respond|contest|ayud|proporcion|ofrec|\bdar\b|cumpl|asist|complac|compart|atend)|\bme niego\b|\bdebo (?:rechazar|declinar)\b"
    r"|\bnao (?:posso|poderei|consigo|podemos|vou|devo)\b[^.!?]*(?:respond|ajud|fornec|\bdar\b|oferec|atend|auxili|compart)|\b(?:me )?recuso\b"
    r"|\bnon (?:posso|potro|possiamo|sono in grado|mi e possibile)\b[^.!?]*(?:rispond|aiut|forn|\bdare\b|assist|soddisf)|\bmi rifiuto\b|\bnu (?:pot|putem)\b[^.!?]*(?:raspun|ajut|ofer)"
    # Finnish, Polish, Czech, Hungarian, Russian, Icelandic, Arabic, Chinese, Japanese
    r"|\ben (?:voi|pysty|saa|halua)\b[^.!?]*(?:vasta|autta|anta|tarjo)|\bnie (?:moge|jestem w stanie|bede|chce)\b[^.!?]*(?:odpow|pomoc|pomag|udziel)|\bodmawiam\b|\bnemohu\b[^.!?]*(?:odpov|pomoc)|\bnem tudok\b[^.!?]*(?:valasz|segit)"
    r"|не (?:могу|буду|в состоянии|имею права)\b[^.!?]*(?:ответ|отвеч|помо|предостав|дать|выполн)|\bотказыва(?:юсь|емся)|\beg get ekki\b[^.!?]*(?:svar|hjalp)|لا (?:استطيع|يمكنني)|(?:无法|不能)(?:回答|提供|协助)|お答えできま"
    # Notices in place of an answer
    rf"|\[[^\]\[]*\b{_THING}\w*\b[^\]\[]*\b{_GONE}|^\W*(?:this |the |bu )?{_THING}\b[^.!?]*\b(?:was|has been|is) {_GONE}"
)
#: No refusal is without one of these; they spare most answers the patterns.
_DECLINING = (
    "mem", "mam", "miyor", "muyor", "meyec", "mayac", "mayiz", "meyiz", "redde", "benden", "n't", "not", "unable", "declin", "refus", " else", "against", "beyond", "outside",
    "nicht", "kein", "lehne", "weiger", "niet", "geen", "inte", "ikke", "je ne", "je n'", "je d", "no p", "no me", "no e", "no v", "no d", "niego", "debo", "nao ", "recuso", "non ", "rifiuto", "nu p",
    "en voi", "en pysty", "en saa", "en halua", "nie ", "odmaw", "nemohu", "nem tud", "не ", "отказ", "eg get", "لا ", "无法", "不能", "お答え", "[",
    "withheld", "removed", "blocked", "filtered", "redacted", "hidden", "suppressed", "censored", "kaldiril", "gizlen", "engel", "filtrelen", "silin", "cikaril",
)
_MARKS_ONLY = re.compile(r"^[\W_]*$")
_PLACE = re.compile(r"^\W*(?:null|none|nil|nan|n/?a|undefined|empty|bos|yok|no (?:answer|response|output|content)|yanit yok|cevap yok|bos yanit|todo|tbd|xxx+|placeholder|lorem ipsum)\W*$")
# What transports report, folded.
_STATUS = r"(?:bad gateway|gateway time-?out|service unavailable|internal server error|too many requests|unauthori[sz]ed|forbidden|not found|request time-?out|payload too large|bad request|overloaded)"
_FAILED = r"(?:request timed? ?out|(?:connection|read|connect|gateway|upstream|socket|network)(?: \w+)? (?:timed? ?out|time-?out|error|reset|refused|aborted|closed)|rate ?limit (?:exceeded|reached|hit)|istek zaman asimina ugradi|istek zaman asimi|zaman asimina ugradi|baglanti (?:hatasi|kesildi|zaman asimi)|sunucu hatasi|finish_reason ?= ?\w+)"
#: How a transport error begins, whatever follows it: a status number, a field of a record, or the report as a sentence of its own.
_ERROR_HEAD = re.compile(
    rf"^\W*(?:traceback \(most recent call last\)|\{{?\s*\"(?:error|hata|status|code|errors)\"\s*:|(?:[a-z_]+[.:])*[a-z_]*(?:error|exception|hata|hatasi)\b\W{{0,3}}(?:code|kodu)?\W{{0,3}}(?:[45]\d\d\b|[:{{\[(])"
    rf"|(?:http(?:/\d(?:\.\d)?)?|status|code|status code|error code|hata kodu)\W{{1,3}}[45]\d\d\b|[45]\d\d\W{{1,4}}{_STATUS}|(?:{_STATUS}|{_FAILED}|timeout|time-?out|error|hata|connection error|api error|server error|network error)\s*(?:[.:;,(\[\-–—]|$))"
)
_LABELS = re.compile(r"\b(?:soru|question|secenekler|options|cevap|answer|yanit|prompt|frage|pregunta|siklar)\b")
# Words that announce an answer, folded.
_ANNOUNCE = frozenset("soru sorunun sorunuzun cevap cevabi yanit yaniti dogru bu secenek secenegi sik sikki answer the correct right is option choice question this to my response reply final antwort die richtige lautet ist reponse la bonne est respuesta correcta es".split())
_LIST_END = re.compile(r"(?:^|\n)\s*(?:\d+[.)]|[-*•])\s*$")
_ABBREV = re.compile(r"\b(?:e\.g|i\.e|orn|bkz|vs|cf|no|s|prof|dr)\.$")
_CLOSED = re.compile(r"[.!?…。:)\]}\"'”’»*`|>✅✔🙂️☑]$|[^\w\s,;(\[{–—\-/]$")

_COMBINING = re.compile("[\u0300-\u036f\u0483-\u0489\u0591-\u05bd\u064b-\u065f\u1ab0-\u1aff\u1dc0-\u1dff\u20d0-\u20ff\ufe20-\ufe2f]+")


@short_cache(100_000)
def fold(s: str) -> str:
    s = s.lower()
    if not s.isascii():
        s = _COMBINING.sub("", unicodedata.normalize("NFKD", s.replace("ı", "i"))).replace("’", "'")
    return s


_HIDDEN = re.compile("[\x00-\x08\x0b-\x1f\x7f-\x9f\xad\u0600-\u0605\u061c\u06dd\u070f\u180e\u200b-\u200f\u202a-\u202e\u2060-\u206f\ue000-\uf8ff\ufeff\ufff9-\ufffb\U000e0000-\U000e007f]")


@short_cache(20_000, 2_000)
def seen(s: str) -> str:
    """What a reader sees of an answer: no tags, entities, fences or invisible characters."""
    s = html.unescape(s) if "&" in s else s
    if "<" in s:
        s = re.sub(r"</?[A-Za-z][^<>]*>|<!--.*?-->", " ", s, flags=re.S)
    return _HIDDEN.sub("", s).strip()


_OPTION = re.compile(r"^\s*\(?([A-Ja-j])[).:]\s*(.+?)\s*$", re.M)
_HEAD = re.compile(r"^\s*(?:soru|question)\s*\d*\s*[:.]\s*", re.I)
_OPTHEAD = re.compile(r"\n\s*(?:se[çc]enekler|options|[şs][ıi]klar|choices)\s*:?\s*\n", re.I)


@short_cache(50_000, 2_000)
def parts(prompt: str) -> tuple[str, tuple[tuple[str, str], ...]]:
    """Question and options (letter, text) of a prompt."""
    m = _OPTHEAD.search(prompt)
    head, tail = (prompt[: m.start()], prompt[m.end() :]) if m else (prompt, "")
    opts = _OPTION.findall(tail)
    if not m and len(found := _OPTION.findall(prompt)) >= 2:
        at = _OPTION.search(prompt).start()
        head, opts = prompt[:at], found
    return _HEAD.sub("", head).strip(), tuple((a.upper(), b) for a, b in opts)


_WORD = re.compile(r"[^\W_]+")


@short_cache(50_000, 2_000)
def tokens(s: str) -> list[str]:
    return _WORD.findall(fold(s))


_ALONE = zstandard.ZstdCompressor(level=3, write_content_size=False, write_checksum=False)
#: Bytes of an empty frame.
_FRAME = 9


@short_cache(50_000, 2_000)
def _alone(text: str) -> int:
    return len(_ALONE.compress(text.encode())) - _FRAME


def left_over(text: str, base: str) -> float:
    """Share of ``text`` that remains when it is compressed with ``base`` as dictionary."""
    data = text.encode()
    if len(data) < 8:
        return 1.0
    d = zstandard.ZstdCompressionDict(base.encode() or b"\0", dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    c = zstandard.ZstdCompressor(level=3, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False)
    return max(0, len(c.compress(data)) - _FRAME) / max(1, _alone(text))


#: Most that may be left of the question given the answer, and of the answer given the prompt.
LEFT = 0.55


def _near(w: str, of: list[str]) -> bool:
    """Whether ``w`` is a slightly altered form of one of the words."""
    return any(w[:k] == x[:k] for x in of if (k := max(2, (2 * min(len(w), len(x)) + 2) // 3)) <= min(len(w), len(x)))


def _answers_beside(ta: list[str], tq: list[str], opts: tuple[tuple[str, str], ...]) -> bool:
    """Whether words of the answer that aren't the question's hold an answer."""
    have = Counter(tq)
    rest = []
    for w in ta:
        if have[w] > 0:
            have[w] -= 1
        elif not _LABELS.fullmatch(w):
            rest.append(w)
    if opts and rest:
        every = [w for a, b in opts for w in (a.lower(), *tokens(b))]
        new = Counter(rest) - Counter(every)
        # The options again, all or as far as they go, are the prompt and no choice.
        if sum(new.values()) <= 0.2 * len(rest) and (len(rest) >= 0.7 * (len(every) - sum((Counter(every) & Counter(tq)).values())) - 1 or rest == every[: len(rest)] and len(rest) > 2 + len(tokens(opts[0][1]))):
            return False
    missing = list((Counter(tq) - Counter(ta)).elements())
    # The same characters with other gaps ("6,3" as "63") are the question's too.
    return "".join(rest) != "".join(missing) and any(not _near(w, missing) for w in rest)


def is_copy(answer: str, prompt: str, left: float = LEFT) -> bool:
    question, opts = parts(prompt)
    ta, tq = tokens(answer), tokens(question)
    if len(tq) < 2 or not ta:
        return False
    na = " ".join(ta)
    # The text after an instruction, as in a translation, can be copied on its own.
    bodies = [tq] + ([tokens(question.split(":", 1)[1])] if ":" in question else [])
    for body in bodies:
        if len(body) > 1 and left_over(" ".join(body), na) <= left and left_over(na, " ".join(tokens(prompt))) <= left:
            return not _answers_beside(ta, tq, opts)
    return False


_QUOTED = re.compile(r"“[^“”]*”|„[^„“”]*[“”]|«[^«»]*»|\"[^\"]*\"|`[^`]*`")


def without_options(answer: str, opts: tuple[tuple[str, str], ...]) -> str:
    for _, b in sorted(opts, key=lambda o: -len(o[1])):
        if len(b) > 1:
            answer = answer.replace(b, " ")
    return unquoted(answer)


def unquoted(s: str) -> str:
    """Text without what it quotes; a text that is one quotation stays."""
    out = _QUOTED.sub(" ", s)
    return out if _WORD.search(out) else s


# Scripts by the names of their letters.
_SCRIPTS = (("CYRILLIC", "ru"), ("ARABIC", "ar"), ("GREEK", "el"), ("CJK", "zh"), ("HIRAGANA", "ja"), ("KATAKANA", "ja"), ("HANGUL", "ko"), ("HEBREW", "he"), ("DEVANAGARI", "hi"), ("THAI", "th"))
_SIGNS = (("ğış", "tr"), ("ßä", "de"), ("ñ", "es"), ("èêàœ", "fr"), ("ãõ", "pt"), ("å", "sv"), ("ðþ", "is"))


def word_votes(w: str) -> tuple[tuple[str, float], ...]:
    """What one word says for each language; names, being capitalised, say little."""
    out = []
    c = w[0]
    if not c.isascii() and len(w) > 1:
        n = unicodedata.name(c, "")
        out += [(code, 1.0) for script, code in _SCRIPTS if n.startswith(script)]
    f = fold(w).split("'")[0]
    if f in _LEX and (len(f) > 1 or c.islower()):
        out += list(_LEX[f].items())
    elif c.islower() and _ENDINGS.match(f):
        out.append(("tr", 0.5))
    if c.islower() and not w.isascii():
        out += [(code, 0.5) for signs, code in _SIGNS if any(x in w for x in signs)]
    return tuple(out)


#: Votes of the words a worker has met.
_VOTES: dict[str, tuple[tuple[str, float], ...]] = {}
_LETTERS = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?")


def votes(text: str) -> dict[str, float]:
    """Evidence for each language in running text."""
    out: dict[str, float] = {}
    if len(_VOTES) > 300_000:
        _VOTES.clear()
    for w in _LETTERS.findall(text):
        said = _VOTES.get(w)
        if said is None:
            said = word_votes(w)
            if len(w) <= 60:
                _VOTES[w] = said
        for code, x in said:
            out[code] = out.get(code, 0.0) + x
    return out


def asked(f: str) -> str | None:
    """Language that a folded prompt asks for, wherever it does; the first request holds.

    In a long prompt a language may only be mentioned ("was printed in German"): a
    request opens its sentence or has a verb of asking in it.
    """
    first = (len(f), None)
    if not _NAMED.search(f):
        return None
    for code, rx in _ASKED.items():
        for m in rx.finditer(f):
            if m.start() >= first[0]:
                break
            lo = max(f.rfind(x, 0, m.start()) for x in ".!?:\n") + 1
            hi = min((k for x in ".!?:\n" if (k := f.find(x, m.end())) >= 0), default=len(f))
            if not f[lo : m.start()].strip(" \t*_\"'(") or _ASKS.search(f, lo, hi):
                first = (m.start(), code)
                break
    return first[1]


@short_cache(50_000, 2_000)
def expected(prompt: str) -> str | None:
    """Language that the prompt asks for, else the one it is in."""
    if (code := asked(fold(prompt))) is not None:
        return code
    # The question's language counts; the rest is asked where the question says nothing.
    v = votes(parts(prompt)[0]) or votes(prompt)
    return max(v, key=v.get) if v else None


def is_foreign(answer: str, prompt: str) -> bool:
    want = expected(prompt)
    if want is None:
        return False
    question, opts = parts(prompt)
    body = without_options(answer, opts)
    if question and question in body:
        body = body.replace(question, " ")
    v = votes(body)
    if sum(v.values()) < 1.5:
        return False
    top = max(v, key=v.get)
    return top != want and v.get(want, 0.0) < 0.4 * v[top] and v[top] >= 1.2


def has_answer(answer: str, opts: tuple[tuple[str, str], ...], question: str) -> bool:
    body = answer.replace(question, " ") if question else answer
    for a, b in opts:
        if len(b) > 2 and b in body:
            return True
    return bool(opts) and bool(re.search(r"(?:^|[\s*(])[A-E]\)", body))


_SENTENCE = re.compile(r"[^.!?]+")


def is_refusal(answer: str, prompt: str) -> bool:
    f = fold(answer)
    if not any(x in f for x in _DECLINING):
        return False
    if not any(_REFUSES.search(x) for x in _SENTENCE.findall(fold(unquoted(answer))) if any(y in x for y in _DECLINING)):
        return False
    question, opts = parts(prompt)
    return not has_answer(answer, opts, question)


def is_empty(answer: str | None, prompt: str | None = None) -> bool:
    if answer is None:
        return True
    s = seen(answer)
    if prompt and s and any(s == b for _, b in parts(prompt)[1]):
        return False
    if _MARKS_ONLY.match(s):
        return True
    f = fold(s)
    return bool(_PLACE.match(f)) or is_error(s, f, prompt or "")


def is_error(s: str, f: str, prompt: str) -> bool:
    """Whether an answer (and its folded form) is a transport error of any length.

    It begins as one, and nothing behind answers the prompt: no option, and no
    prose with words of the question.
    """
    if not _ERROR_HEAD.match(f):
        return False
    question, opts = parts(prompt)
    asked_for = {w for w in tokens(question) if w not in _LEX}
    prose = sum(votes(s).values()) >= 1.5
    return not has_answer(s, opts, question) and not (prose and not asked_for.isdisjoint(_WORD.findall(f)))


def ending(answer: str) -> str:
    """How an answer closes: ``closed``, ``open`` (something in it isn't closed) or ``bare``."""
    s = seen(answer)
    s = re.sub(r"\s*```\s*$", "", s) if "```" in s and s.count("```") % 2 == 0 else s
    f = fold(s)
    if s.count("```") % 2 or s.count("**") % 2 and not s.endswith("*"):
        return "open"
    if _LIST_END.search(s) and "\n" in s:
        return "open"
    end = f.rsplit(None, 1)[-1] if f else ""
    if _ABBREV.search(end) and not re.search(r"\b(?:no|s|vs)\.$", end):
        return "open"
    if f.count("(") > f.count(")") and f.rfind("(") > f.rfind(")"):
        return "open"
    if s.count("“") > s.count("”") or s.count('"') % 2 and re.sub(r"\w\"|[^\w]\"$", "", s).count('"') % 2:
        return "open"
    return "closed" if _CLOSED.search(s[-1:]) else "bare"


_TAIL = re.compile(r"(?:^|[\s*(\[])\(?([A-Ea-e])[).:]\s*([^\n]*)$")
#: A letter as the answer: alone, or behind a mark or a word that announces it.
_LETTER_END = re.compile(r"(?:^|[:*(]|\b(?:cevap|cevabi|yanit|yaniti|answer|is|option|sik|secenek|antwort|ist|reponse|est|respuesta|es)\b)\s*\**\(?[A-E]\)?\W*$", re.I)
_LETTER_LAST = re.compile(r"\W*[A-Ea-e](?![^\W_])")
_NUMBER = re.compile(r"[\d.,%\s]+(?:\s?\w+(?:/\w+)?)?")


def breaks_off(answer: str, prompt: str) -> str | None:
    """``TRUNCATED``, ``ASK`` where the terminal-context model has to tell, or None."""
    question, opts = parts(prompt)
    whole = seen(answer)
    if question and question in whole:  # a repeated question neither closes nor opens what follows
        whole = whole.replace(question, " ").strip() or whole
    s = whole.strip("*_` \n")
    texts = {" ".join(b.split()) for _, b in opts}
    flat = " ".join(s.split())
    m = _TAIL.search(s.split("\n")[-1] if "\n" in s else s)
    last = " ".join((m[2] if m else flat).strip("*_` \"").split())
    loose = " ".join((m[2] if m else flat).split())
    for x in (last, last.rstrip("."), loose, loose.rstrip("."), loose.strip("*_` "), flat, flat.rstrip(".")):
        if x in texts:
            return None
    if m and not last:
        return TRUNCATED if whole.rstrip().endswith(("(", ",", ":", ";")) else None
    if _LETTER_LAST.match(flat[::-1]) and _LETTER_END.search(flat):
        return None
    state = ending(answer)
    if state == "open":
        return TRUNCATED
    ws = tokens(flat)
    if ws and _ANNOUNCE.issuperset(ws) and (state == "bare" or flat.endswith(":")) or flat.endswith(":"):
        return TRUNCATED  # it announces an answer and gives none
    bare = last if m else flat
    stem = bare.rstrip(".")
    if stem and (m or state == "bare") and any(len(b) > len(stem) and b.startswith(stem) for b in texts) and not flat.endswith(("!", "?", ")", '"')):
        return TRUNCATED  # an option cut short
    if state == "closed" or _NUMBER.fullmatch(flat):
        return None
    return ASK


_LETTER = re.compile(r"\(?([A-Ja-j])\s*[).:]?\)?\s*")


def is_choice(answer: str, prompt: str) -> bool:
    """Whether an answer is a letter, an option or both and nothing else."""
    _, opts = parts(prompt)
    if not opts:
        return False
    s = answer.strip("*_` \n")
    texts = [b for _, b in opts]
    m = _LETTER.match(s)
    return s in texts or bool(m) and (s[m.end() :] in texts or m.end() == len(s))


def first_look(answer: str | None, prompt: str | None) -> str | None:
    """Kind of the defect, None, or ``ASK`` where only the terminal-context model can tell."""
    if is_empty(answer, prompt):
        return EMPTY
    p, a = prompt or "", seen(answer)
    if p and is_choice(a, p):
        return None
    if is_refusal(a, p):
        return REFUSAL
    if p and is_copy(a, p):
        return COPY
    if p and is_foreign(a, p):
        return LANGUAGE
    return breaks_off(answer, p)


def closes_elsewhere(answer: str) -> bool:
    """Whether other sentences of the text close with a mark."""
    return bool(re.search(r"[.!…]\s", seen(answer)))


def settle(answer: str, share: float | None) -> str | None:
    """What the model's share of ends says; without evidence the text's own closed sentences do."""
    return TRUNCATED if (closes_elsewhere(answer) if share is None else share < 0.5) else None


def defect(answer: str | None, prompt: str | None, end_share: float | None) -> str | None:
    """Kind of the defect, or None. A null prompt takes no part in the comparison."""
    got = first_look(answer, prompt)
    return settle(answer, end_share) if got == ASK else got


# --- the terminal-context model ---

_CONTEXT = re.compile(r"[^\W_]+|[^\w\s]")
_START = "\u0002"
#: Hashes of the tokens a worker has met, and of their beginnings.
_SEEN: dict[str, int] = {}
_BEGIN: dict[int, np.ndarray] = {}
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _digest(w: str) -> int:
    return xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass"))


def context_tokens(answer: str) -> list[str]:
    return _CONTEXT.findall(fold(seen(answer)))


def _ids(ws: list[str]) -> list[int]:
    if len(_SEEN) > 200_000:
        _SEEN.clear()
        _BEGIN.clear()
    out = []
    for w in ws:
        h = _SEEN.get(w)
        if h is None:
            h = _SEEN[w] = _digest(w)
            _BEGIN[h] = np.array([_digest(w[:k]) for k in range(1, len(w))] if len(w) <= 60 else [], dtype=np.uint64)
        out.append(h)
    return out


def _mixed(*hs: np.ndarray) -> np.ndarray:
    """Keys of contexts: hashes of one, two or three neighbouring tokens; the number of tokens is part of it."""
    x = np.full(len(hs[0]), len(hs), dtype=np.uint64)
    for h in hs:
        x = (x ^ h) * _MIX
        x ^= x >> np.uint64(31)
    return x


def terminal_keys(answer: str) -> list[int]:
    """Keys of the last one, two and three tokens, the start of the text being one."""
    h = np.array(_ids([_START, *context_tokens(answer)][-3:]), dtype=np.uint64)
    return [int(_mixed(*(h[k : k + 1] for k in range(len(h) - n, len(h))))[0].astype(np.int64)) for n in range(1, min(3, len(h)) + 1)]


def going_on(answers: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Keys of all contexts in the texts behind which the text goes on, and how often.

    A last word before closing marks says nothing either way. Beginnings of a word
    count as contexts of two tokens that go on by letters.
    """
    hs: list[int] = []
    size, last = [], []
    for a in answers:
        ws = context_tokens(a)
        hs += _ids([_START, *ws])
        size.append(len(ws) + 1)
        last.append(next((k for k in range(len(ws), 0, -1) if ws[k - 1][0].isalnum()), 0))
    if not hs:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    h = np.array(hs, dtype=np.uint64)
    at = np.arange(len(h)) - np.repeat(np.cumsum(size) - size, size)  # place in its text, 0 being the start
    go = (at > 0) & (at < np.repeat(last, size))
    keys = []
    for n in (1, 2, 3):
        k = np.flatnonzero(go & (at >= n - 1))
        keys.append(_mixed(*(h[k - d] for d in range(n - 1, -1, -1))))
    key, n = np.unique(np.concatenate(keys), return_counts=True)
    # Beginnings, worked out once for each pair of neighbours.
    k = np.flatnonzero(at >= 1)
    _, one, m = np.unique(_mixed(h[k - 1], h[k]), return_index=True, return_counts=True)
    begins = [_BEGIN.get(w, ()) for w in h[k[one]].tolist()]
    size = np.array([len(b) for b in begins])
    if size.sum():
        more = _mixed(np.repeat(h[k[one] - 1], size), np.concatenate([b for b in begins if len(b)]))
        key, n = np.concatenate([key, more]), np.concatenate([n, np.repeat(m, size)])
    key, at = np.unique(key, return_inverse=True)
    return key.astype(np.int64), np.bincount(at, weights=n).astype(np.int64)


_LOOKED = "h string, defect string, closes boolean, keys array<long>, key long, n long"


def _look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Labels of pairs and, beside them, the contexts counted in their answers."""
    for b in batches:
        answers = [x for x in b["a"] if x is not None]
        kinds = [first_look(a, p) for a, p in zip(b["a"], b["p"])]
        ask = [k == ASK for k in kinds]
        yield pd.DataFrame({
            "h": b["h"], "defect": pd.Series(kinds, dtype=object),
            "closes": pd.Series([closes_elsewhere(a) if q else None for a, q in zip(b["a"], ask)], dtype=object),
            "keys": pd.Series([terminal_keys(a) if q else None for a, q in zip(b["a"], ask)], dtype=object),
            "key": pd.Series([None] * len(b), dtype="Int64"), "n": pd.Series([None] * len(b), dtype="Int64"),
        })
        step, size, group = 2_000_000, 0, []
        for a in [*answers, None]:  # a bound on memory; texts are never cut
            if a is None or size + len(a) > step and group:
                key, n = going_on(group)
                none = pd.Series([None] * len(key), dtype=object)
                yield pd.DataFrame({"h": none, "defect": none, "closes": none, "keys": none, "key": pd.Series(key, dtype="Int64"), "n": pd.Series(n, dtype="Int64")})
                size, group = 0, []
            if a is not None:
                group.append(a)
                size += len(a)


def flag_pairs(df: DataFrame, prompt: str, answer: str, key: list[str]) -> DataFrame:
    """``key`` columns and ``defect`` (null where there is none) of every row.

    A null answer is ``empty``; a null prompt leaves the tests that need one aside.
    Each distinct pair is judged once and its label joined back, so repeated rows
    are labelled alike and a hot prompt costs no more than a rare one. Length is
    unbounded; an empty table gives an empty table.
    """
    rows = df.select(F.struct(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(key)]).alias("keep"), F.col(f"`{prompt}`").alias("p"), F.col(f"`{answer}`").alias("a"))
    rows = rows.withColumn("h", F.md5(F.concat(F.coalesce("p", F.lit("\u0000")), F.lit("\u0001"), F.coalesce("a", F.lit("\u0000")))))
    # Repeated pairs are folded before the shuffle, so a hot one is a row per task. Texts
    # are shuffled once and never written: what goes on are labels, keys and counts.
    distinct = rows.groupBy("h").agg(F.first("p").alias("p"), F.first("a").alias("a"))
    looked = cut(distinct.mapInPandas(_look, _LOOKED))
    labels = looked.where("h is not null").select("h", "defect", "closes", "keys")
    ask = labels.where(F.col("defect") == ASK).select("h", "closes", F.posexplode("keys").alias("order", "key"))
    ends = ask.groupBy("key").agg(F.count("*").alias("n_end"))
    goes = looked.where("key is not null").groupBy("key").agg(F.sum("n").alias("n_on"))
    model = ends.join(goes, "key", "left").select("key", "n_end", F.coalesce("n_on", F.lit(0)).alias("n_on"))
    # An answer is no evidence for itself; a context that occurs nowhere else has none.
    told = ask.join(model, "key").withColumn("others", F.col("n_end") - 1 + F.col("n_on"))
    share = F.when(F.col("others") > 0, (F.col("n_end") - 1) / F.col("others"))
    settled = told.groupBy("h").agg(F.min(share).alias("share"), F.first("closes").alias("closes"))
    broken = F.coalesce(F.col("share") < 0.5, F.col("closes"))
    settled = settled.where(broken).select("h", F.lit(TRUNCATED).alias("defect"))
    sure = labels.where(F.col("defect") != ASK).select("h", "defect")
    return rows.select("keep", "h").join(sure.unionByName(settled), "h", "left").select(*[F.col("keep").getField(f"k{i}").alias(c) for i, c in enumerate(key)], "defect")
