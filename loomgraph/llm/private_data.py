"""Personal data in disguise (operator 13): transducers that keep offsets.

1. Base: mail addresses, IP addresses, card and phone numbers as plain patterns find them in the text as it stands.
2. A transducer rewrites parts of a text and keeps, for each rewritten part, its place before and after; so a chain of them maps any span of its output back to characters of
   the source. Three of them are chained:
   homoglyphs - full-width, mathematical, circled and other compatibility forms, digits of all scripts, letters of other alphabets that look like Latin ones, odd
     spaces, dashes and dots become ASCII; characters that aren't seen go;
   addresses - at and dot in words, brackets, entities or between spaces become @ and ., where a name stands before and a host with a known or plausible end behind;
   digits - chains of spelled digits (four languages, double and triple), digits, dots in disguise and a spelled plus become figures; letters that look like
     figures become such in words that are mostly figures.
3. The plain patterns run again on the output, and what they find is mapped back. A span that lies inside one of the base, of its kind, adds nothing; others are added, also where they
   hold a base span that saw a part of the identifier only.

A text that holds nothing to rewrite (most do) costs a few searches. Every document is worked on alone: no shuffle, and a lost executor costs its tasks only.

Defined results: null counts as empty, which has no spans. Spans are code points, end exclusive; several kinds may overlap. Repeated rows are judged alike. Very long texts are
handled whole, in linear time. An empty table gives an empty result. Other columns are not read, so their names can't clash.
"""

from __future__ import annotations

import bisect
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import slices

KINDS = ("email", "ip", "card", "phone")
SCHEMA = "doc_id bigint, spans array<struct<kind:string,start:int,end:int,base:boolean,value:string>>"
SPAN = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_()), ("value", pa.string())])

# Letters that look like Latin ones, by alphabet, each with the letter it looks like.
CYRILLIC = dict(zip("АВЕЅІЈКМНОРСТУХЬаеорсухіјѕһԁԛԝӏґɡ", "ABESIJKMHOPCTYXbaeopcyxijshdqwlrg", strict=True)) | {"З": "3", "б": "6"}
GREEK = dict(zip("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧανορτυχιϲϳ", "ABEZHIKMNOPTYXavoptuxicj", strict=True))
OTHER = dict(zip("ıȷɑɩʏʟɴʀᴀᴄᴅᴇᴊᴋᴍᴏᴘᴛᴜᴠᴡᴢꜰꜱ", "ijaiylnracdejkmoptuvwzfs", strict=True))
ARMENIAN = dict(zip("օսցոհ", "ougnh", strict=True))
SIGNS = {"․": ".", "·": ".", "•": ".", "∙": ".", "⋅": ".", "。": ".", "｡": ".", "٫": ".", "−": "-", "₋": "-", "﹫": "@", "＠": "@", "ⓐ": "@", "⊕": "+", "➕": "+"}
# Digits in words, by language (zero to nine).
NUMBERS = [
    "zero one two three four five six seven eight nine".split(),
    "null eins zwei drei vier fünf sechs sieben acht neun".split(),
    "zéro un deux trois quatre cinq six sept huit neuf".split(),
    "cero uno dos tres cuatro cinco seis siete ocho nueve".split(),
]
SPELLED = {w: str(k) for words in NUMBERS for k, w in enumerate(words)} | {"oh": "0", "zwo": "2", "fuenf": "5"}
TIMES = {"double": 2, "triple": 3, "doppel": 2, "doble": 2}
# Ends of host names that count behind an at in plain words.
ENDS = frozenset("com org net edu gov mil int info biz io co ai app dev me tv eu uk us ca de fr es it nl ch at be pl ru cn jp br in au se no dk fi pt mx ar cl nz ie example test invalid".split())
LOOKALIKE = str.maketrans("OoQDIil|ZSB", "00001111258")
#: Spelled digits that a chain has at least, unless its dots make it an address.
FEWEST_SPELLED = 3


def homoglyphs() -> tuple[dict[int, str], dict[int, str]]:
    """Characters that become one ASCII character, and those that become none or several."""
    one, other = {}, {}
    for c in (*range(0xA0, 0xD800), *range(0xF900, 0x10000), *range(0x1D400, 0x1D800), *range(0x1F100, 0x1F190), *range(0x1FBF0, 0x1FBFA)):
        ch = chr(c)
        kind, digit = unicodedata.category(ch), unicodedata.decimal(ch, None)
        plain = str(digit) if digit is not None else " " if kind == "Zs" else "-" if kind == "Pd" else "" if kind == "Cf" or 0xFE00 <= c <= 0xFE0F else unicodedata.normalize("NFKC", ch)
        if len(plain) == 1 and plain.isascii() and plain.isprintable():
            one[c] = plain
        elif not plain or plain.isascii() and plain.isalnum():
            other[c] = plain
    one |= {ord(a): b for table in (CYRILLIC, GREEK, OTHER, ARMENIAN, SIGNS) for a, b in table.items()}
    return one, other


def char_class(codes) -> str:
    """A regular expression's class of these characters."""
    out, codes = [], sorted(codes)
    for c in codes:
        if out and c == out[-1][1] + 1:
            out[-1][1] = c
        else:
            out.append([c, c])
    return "[" + "".join(f"{re.escape(chr(a))}-{re.escape(chr(b))}" for a, b in out) + "]"


ONE, SEVERAL = homoglyphs()
ODD, UNEVEN = re.compile(char_class([*ONE, *SEVERAL])), re.compile(char_class(SEVERAL))
LATIN_ODD = bytes(c for c in (*ONE, *SEVERAL) if c < 256)

AT_WORD = r"(?i:at|arroba|chez)"
DOT_WORD = r"(?i:dot|punkt|punto|point)"
#: An at in disguise: in brackets, as an entity, in signs; then in plain words. (Sizes of gaps are bounded, so that long white space costs no more than it is long.)
EXPLICIT_AT = rf"(?:[ \t]{{0,4}}[\[({{<][ \t]{{0,4}}(?:{AT_WORD}|@)[ \t]{{0,4}}[\])}}>][ \t]{{0,4}}|[ \t]{{0,4}}(?:&#64;|&#[xX]40;|&commat;|%40)[ \t]{{0,4}}|[ \t]{{0,4}}@[ \t]{{0,4}})"
WORD_AT = rf"(?:[ \t]{{1,4}}{AT_WORD}[ \t]{{1,4}}|[_-]{AT_WORD}[_-])"
SIGN_DOT = rf"(?:[ \t]{{0,4}}[\[({{<][ \t]{{0,4}}(?:{DOT_WORD}|\.)[ \t]{{0,4}}[\])}}>][ \t]{{0,4}}|[ \t]{{0,4}}(?:&#46;|&#[xX]2[eE];|&period;)[ \t]{{0,4}}|[ \t]{{1,4}}\.[ \t]{{1,4}}|[_-]{DOT_WORD}[_-])"
HIDDEN_DOT = rf"(?:{SIGN_DOT}|[ \t]{{1,4}}{DOT_WORD}[ \t]{{1,4}})"
DOT = rf"(?:\.|{HIDDEN_DOT})"
LABEL = r"[A-Za-z0-9]++(?:-++[A-Za-z0-9]++)*+"
HOST = re.compile(rf"{LABEL}(?:{DOT}{LABEL})+")
AT = re.compile(rf"(?:(?P<sign>{EXPLICIT_AT})|(?P<word>{WORD_AT}))(?={LABEL}{DOT}[A-Za-z0-9])")
DOTS, HIDDEN = re.compile(DOT), re.compile(HIDDEN_DOT)
BEFORE = re.compile(rf"[A-Za-z0-9._%+-]{HIDDEN_DOT}\Z")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DISGUISE = re.compile(rf"@|[\[({{<][ \t]{{0,4}}(?:{AT_WORD}|@)[ \t]{{0,4}}[\])}}>]|&#64;|&#[xX]40;|&commat;|%40|[ \t_-]{AT_WORD}[ \t_-]")

NUMBER = "(?:" + "|".join(sorted(SPELLED, key=len, reverse=True)) + ")"
REPEAT = "(?:" + "|".join(TIMES) + ")"
ITEM = rf"(?:{REPEAT}[ -])?{NUMBER}(?![^\W_])|[0-9]++(?![^\W\d_])"
GAP = r"[ \t(),-]{1,3}"
CHAIN = re.compile(rf"(?<![^\W_])(?:(?P<plus>\+|plus)[ \t]?+)?\(?(?:{ITEM})(?:(?:{DOT}|{GAP})(?:{ITEM}))+")
PIECE = re.compile(rf"(?P<times>{REPEAT})[ -](?P<many>{NUMBER})(?![^\W_])|(?P<number>{NUMBER})(?![^\W_])|(?P<plus>plus(?=[ \t(]))|(?P<dot>{HIDDEN_DOT})|(?P<gap>[ \t,-]++)")
#: What a chain that is worth rewriting holds: a spelled digit between a gap and another digit, or a hidden dot between digits.
SPELT = re.compile(rf"[ \t(),-]{NUMBER}{GAP}(?:(?:{REPEAT}[ -])?{NUMBER}(?![^\W_])|[0-9])")
DOTTED = re.compile(rf"(?:[\[({{<][ \t]{{0,4}}(?:{DOT_WORD}|\.)[ \t]{{0,4}}[\])}}>]|&#46;|&#x2e;|&period;|[ \t]\.[ \t]|[ \t_-]{DOT_WORD}[ \t_-])[ \t]{{0,4}}(?:[0-9]|{NUMBER})")
LAST_DIGIT = re.compile(rf"(?:[0-9]|{NUMBER})[ \t]{{0,4}}\Z")
MIXED = re.compile(r"(?<![^\W_])(?=[0-9OoQDIil|ZSB]*[0-9])[0-9OoQDIil|ZSB]++(?![^\W_])")
MIX = re.compile(r"[0-9][OoQDIil|ZSB]|[OoQDIil|ZSB][0-9]")

IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    return sum(sum(divmod(int(d) << (k & 1), 10)) for k, d in enumerate(reversed(digits))) % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost addresses, one sign after the other: what stands before it as far as it can belong to a name, and the host behind it."""
    end, at = 0, text.find("@")
    while at >= 0:
        if host := DOMAIN.match(text, at + 1):
            start = at
            while start > end and text[start - 1] in LOCAL:
                start -= 1
            if start < at:
                end = host.end()
                yield start, end
        else:
            end = max(end, at + 1)  # no name reaches over a sign
        at = text.find("@", max(at + 1, end))


def numbers(text: str) -> Iterator[tuple[str, int, int]]:
    """IP addresses, cards and phones, those that pass their checks."""
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m.group().split(".")):
            yield "ip", m.start(), m.end()
    for m in CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            yield "card", m.start(), m.end()
    for m in PHONE.finditer(text):
        if 9 <= sum(c.isdigit() for c in m.group()) <= 15:
            yield "phone", m.start(), m.end()


def identifiers(text: str) -> list[tuple[str, int, int]]:
    """The plain patterns' spans: leftmost and non-overlapping in each kind."""
    out = [("email", a, b) for a, b in emails(text)]
    return out + list(numbers(text)) if DIGIT.search(text) else out


class Rewritten:
    """A text as a chain of transducers left it, with the way back to the source."""

    def __init__(self, text: str):
        self.text, self.steps = text, []

    def same_length(self, text: str) -> Rewritten:
        """Characters were replaced one by one, so no place has moved."""
        self.text = text
        return self

    def rewrite(self, parts: list[tuple[int, int, str]]) -> Rewritten:
        """Replace parts (start, end, new text), which rise and don't overlap."""
        if parts:
            out, at, moved, begins, rows = [], 0, 0, [], []
            for start, end, new in parts:
                out += [self.text[at:start], new]
                begins.append(start + moved)
                rows.append((start + moved, start + moved + len(new), start, end))
                moved += len(new) - (end - start)
                at = end
            out.append(self.text[at:])
            self.text = "".join(out)
            self.steps.append((begins, rows))
        return self

    def source(self, start: int, end: int) -> tuple[int, int]:
        """The span of the source that a span of this text comes from. A replaced part comes from the whole of what it replaced."""
        for begins, rows in reversed(self.steps):
            start, end = place(begins, rows, start, False), place(begins, rows, end - 1, True)
        return start, end

    def copy(self) -> Rewritten:
        other = Rewritten(self.text)
        other.steps = self.steps[:]
        return other


def place(begins: list[int], rows: list[tuple[int, int, int, int]], at: int, behind: bool) -> int:
    """Where a character came from: its first place, or the one behind it."""
    k = bisect.bisect_right(begins, at) - 1
    while k >= 0:
        new, stop, old, end = rows[k]
        if at < stop:
            return end if behind else old
        if new <= at:
            return end + at - stop + behind
        k -= 1
    return at + behind


def has_odd(text: str) -> bool:
    """Whether the homoglyph transducer has anything to do; most texts are ASCII or Latin-1, which is told without looking at each character here."""
    if text.isascii():
        return False
    try:
        latin = text.encode("latin-1")
    except UnicodeEncodeError:
        return bool(ODD.search(text))
    return len(latin.translate(None, LATIN_ODD)) < len(latin)


def plain_letters(r: Rewritten) -> Rewritten:
    """The homoglyph transducer."""
    if not has_odd(r.text):
        return r
    r.rewrite([(m.start(), m.end(), SEVERAL[ord(m.group())]) for m in UNEVEN.finditer(r.text)])
    return r.same_length(r.text.translate(ONE))


def host_end(text: str, at: int, known: bool) -> tuple[int, bool]:
    """Where the longest host that begins here ends (0: there is none), and whether a dot of it is hidden. known: its end must be on the list, else letters do."""
    m = HOST.match(text, at)
    if not m:
        return 0, False
    cuts = [(d.start(), d.end(), bool(HIDDEN.fullmatch(d.group()))) for d in DOTS.finditer(text, at, m.end())]
    for k in range(len(cuts), 0, -1):
        stop = cuts[k][0] if k < len(cuts) else m.end()
        last = text[cuts[k - 1][1] : stop].lower()
        if last in ENDS if known else len(last) > 1 and last.isalpha():
            return stop, any(hidden for *_, hidden in cuts[:k])
    return 0, False


def plain_addresses(r: Rewritten) -> Rewritten:
    """The transducer of at and dot."""
    text, parts, done = r.text, [], 0
    for d in DISGUISE.finditer(text):
        begin = d.start()
        while begin > max(done, d.start() - (3 if text[d.start()] in " \t" else 4)) and text[begin - 1] in " \t":
            begin -= 1
        m = AT.match(text, begin)
        if not m:
            continue
        stop, hidden = host_end(text, m.end(), m["sign"] is None)
        # a bare word needs a hidden dot behind it, or a name before it that is no plain word
        if not stop or m.start() < done or (m.group() == "@" and not hidden):
            continue
        dots, start = [], m.start()
        while True:
            while start > done and text[start - 1] in LOCAL:
                start -= 1
            gap = BEFORE.search(text, max(done, start - 20), start) if start > done else None
            if not gap:
                break
            dots.append((gap.start() + 1, start, "."))
            start = gap.start() + 1
        name = text[start : m.start()]
        if not name or (m["sign"] is None and not hidden and not dots and name.isalpha()):
            continue
        parts += [*reversed(dots), (m.start(), m.end(), "@")]
        parts += [(d.start(), d.end(), ".") for d in HIDDEN.finditer(text, m.end(), stop)]
        done = stop
    return r.rewrite([p for p in parts if text[p[0] : p[1]] != p[2]])


def chain_parts(text: str, begin: int, end: int) -> list[tuple[int, int, str]]:
    """How a chain of digits is rewritten; nothing if it has too few words and hidden dots."""
    found, spelled, dots = [], 0, 0
    for m in PIECE.finditer(text, begin, end):
        if m["number"]:
            found.append((*m.span(), SPELLED[m["number"]]))
            spelled += 1
        elif m["many"]:
            found.append((*m.span(), SPELLED[m["many"]] * TIMES[m["times"]]))
            spelled += TIMES[m["times"]]
        elif m["dot"]:
            found.append((*m.span(), "."))
            dots += 1
        elif m["plus"]:
            found.append((*m.span(), "+"))
        else:
            # a gap beside a word goes, and one behind a plus; others stay
            found.append((*m.span(), ""))
    if spelled < FEWEST_SPELLED:
        if not dots or text.count(".", begin, end) + dots < 3:
            return []
    kept = []
    for k, (a, b, new) in enumerate(found):
        if not new:
            beside = (k and found[k - 1][1] == a and found[k - 1][2].strip(".") != "") or (k + 1 < len(found) and found[k + 1][0] == b and found[k + 1][2].strip(".") != "")
            if not (beside or text[a - 1 : a] == "+"):
                continue
        kept.append((a, b, new))
    return kept


def plain_digits(r: Rewritten) -> Rewritten:
    """The transducer of spelled digits, and that of letters that look like figures."""
    low = r.text.lower()
    if len(low) != len(r.text):
        low = "".join(c if len(c.lower()) != 1 else c.lower() for c in r.text)
    if SPELT.search(low) or any(LAST_DIGIT.search(low, max(0, m.start() - 12), m.start()) for m in DOTTED.finditer(low)):
        r.rewrite([p for m in CHAIN.finditer(low) for p in chain_parts(low, *m.span())])
    if DIGIT.search(r.text) and MIX.search(r.text):
        out = [(m.start(), m.group()) for m in MIXED.finditer(r.text)]
        text = list(r.text)
        for at, word in out:
            figures = word.translate(LOOKALIKE)
            if sum(map(str.isdigit, word)) * 2 >= len(word):
                text[at : at + len(word)] = figures
        r.same_length("".join(text))
    return r


def found_in(text: str) -> list[tuple[str, int, int, bool, str]]:
    """kind, start, end, whether the plain patterns see it, and the identifier in plain characters; by kind and place."""
    base = identifiers(text)
    out = {(k, a, b): (True, text[a:b]) for k, a, b in base}
    letters = plain_letters(Rewritten(text))
    seen: set[int] = {id(text)}
    spans = {k: [(a, b) for kind, a, b in base if kind == k] for k in KINDS}
    for r, kinds in ((plain_addresses(letters.copy()), KINDS[:1]), (plain_digits(letters.copy()), KINDS[1:])):
        if r.text == text and id(r.text) in seen:
            continue
        for kind, a, b in identifiers(r.text):
            start, end = r.source(a, b)
            if kind in kinds and not any(x <= start and end <= y for x, y in spans[kind]):
                out.setdefault((kind, start, end), (False, r.text[a:b]))
    return [(*k, *out[k]) for k in sorted(out, key=lambda k: (KINDS.index(k[0]), *k[1:]))]


def detect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [f.name for f in SPAN]
    for batch in slices(batches):
        some = batch.column(batch.schema.get_field_index("text")).to_pylist()
        spans = [[dict(zip(names, s)) for s in found_in(x or "")] for x in some]
        yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("doc_id")).cast(pa.int64()), pa.array(spans, pa.list_(SPAN))], names=["doc_id", "spans"])


def private_data(docs: DataFrame) -> DataFrame:
    """doc_id, spans (kind, start, end, base, value) by kind and place."""
    return docs.select("doc_id", "text").mapInArrow(detect, SCHEMA)


def told(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def counted(spans: Column, kind: str, base: bool | None = None) -> Column:
    return F.size(F.filter(spans, lambda s: (s["kind"] == kind) & (F.lit(True) if base is None else s["base"] == base))).cast("long")


