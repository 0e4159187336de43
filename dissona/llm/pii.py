"""Personal data: offset-preserving deobfuscation.

The base detectors run on each text as it stands. Then a transducer rewrites disguises and keeps, for every character it puts
out, the source interval it came from: look-alike letters and digits of other scripts become ASCII, invisible characters vanish,
runs of spelled digits become digits, `(at)`, `[dot]`, ` at ... dot ` and the like become @ and a full stop, and so does a spelled
`dot` or `point` between the numbers, spelled or not, of an address of four or more. The same detectors run on
the rewritten text; each find goes back through the intervals to a source span and is reported if a rewriting had a part in it
and no base span covers it. Kinds of added spans are those of the base.

Defined cases: null text is empty (no spans); a null doc_id stays null; repeated rows give repeated results; an empty table gives an
empty result; other columns are ignored; texts are processed whole, in time proportional to their length.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_and_text, map_rows

KINDS = ("email", "ip", "card", "phone")
LOCAL_END = re.compile(r"[A-Za-z0-9._%+-]")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")  # within a run of digits no later start can match where its first can't
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile("[0-9]")

Span = tuple[int, int, int]  # kind, start, end


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def emails(text: str) -> list[Span]:
    """From each @ to the left and to the right: what the leftmost, non-overlapping matches are, in linear time."""
    out, last, at = [], 0, text.find("@")
    while at >= 0:
        s = at
        while s > last and LOCAL_END.match(text[s - 1]):
            s -= 1
        m = DOMAIN.match(text, at + 1) if s < at else None
        if m:
            out.append((0, s, m.end()))
            last = m.end()
        at = text.find("@", at + 1)
    return out


def detect(text: str) -> list[Span]:
    """The base kinds, by kind, then start."""
    out = emails(text) if "@" in text else []
    if DIGIT.search(text):
        if "." in text:
            out += [(1, m.start(), m.end()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split("."))]
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 13:
                digits = re.sub("[^0-9]", "", m[0])
                if 13 <= len(digits) <= 19 and luhn(digits):
                    out.append((2, m.start(), m.end()))
        if "+" in text:
            out += [(3, m.start(), m.end()) for m in PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return out


# Spelled digits, letters of other scripts that look like ASCII ones, and endings of host names.
SPELLED = {"zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9", "plus": "+", "dash": "-"}
LOOKALIKES = {"а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "һ": "h", "ӏ": "l", "ո": "n", "α": "a", "ο": "o", "ν": "v", "ι": "i", "ρ": "p", "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "Х": "X", "Ο": "O", "Α": "A", "Β": "B", "Ε": "E", "‚": ",", "․": ".", "。": ".", "‐": "-", "‑": "-", "–": "-", "−": "-", "¹": "1", "²": "2", "³": "3"}
INVISIBLE = "​‌‍⁠﻿­"
WORD = "|".join(SPELLED)
RUN = re.compile(rf"(?<![^\W_])(?:{WORD})(?:[\x20,.-]{{1,3}}(?:{WORD}|[0-9]+)){{5,}}(?![^\W_])", re.I)
ONE = re.compile(rf"(?<![^\W_])(?:{WORD}|[0-9]+)(?![^\W_])", re.I)
DIGIT_WORD = "|".join(w for w, d in SPELLED.items() if d.isdigit())
NUMBER = rf"(?:[0-9]+|(?:{DIGIT_WORD})(?:[\x20-]{{1,3}}(?:{DIGIT_WORD}|[0-9])){{0,3}})(?![^\W_])"  # a part of an address has few digits
POINT = r"(?:dot|point|punkt|punto)"
QUAD = re.compile(rf"(?<![^\W_])(?<![0-9]\.){NUMBER}(?:(?:\x20+{POINT}\x20+|\.){NUMBER}){{3,}}", re.I)
PART = re.compile(rf"(\x20+{POINT}\x20+)|({NUMBER})", re.I)
DIRECT = re.compile(r"[\x20\t]*[\[({<][\x20\t]*(at|dot|punkt|punto|point|arroba|@|\.)[\x20\t]*[\])}>][\x20\t]*", re.I)
ENDINGS = frozenset(
    "com net org edu gov mil int info biz name io ai app dev pro xyz online site store shop tech cloud club live blog top world email agency digital media jobs mobi cat coop aero museum travel asia post tel arpa test example invalid local "
    "ac ad ae af ag al am ao aq ar as at au aw ax az ba bb bd be bf bg bh bi bj bm bn bo br bs bt bv bw by bz ca cc cd cf cg ch ci ck cl cm cn co cr cu cv cw cx cy cz de dj dk dm do dz ec ee eg er es et eu fi fj fk fm fo fr "
    "ga gb gd ge gf gg gh gi gl gm gn gp gq gr gs gt gu gw gy hk hm hn hr ht hu id ie il im in iq ir is it je jm jo jp ke kg kh ki km kn kp kr kw ky kz la lb lc li lk lr ls lt lu lv ly ma mc md me mg mh mk ml mm mn mo mp mq mr ms mt mu mv mw mx my mz "
    "na nc ne nf ng ni nl no np nr nu nz om pa pe pf pg ph pk pl pm pn pr ps pt pw py qa re ro rs ru rw sa sb sc sd se sg sh si sj sk sl sm sn so sr ss st su sv sx sy sz tc td tf tg th tj tk tl tm tn to tr tt tv tw tz ua ug uk us uy uz va vc ve vg vi vn vu wf ws ye yt za zm zw".split()
)
PLAIN = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]+(@|\x20+at\x20+)[A-Za-z0-9-]+(?:(?:\x20+dot\x20+|\.)[A-Za-z0-9-]+)+", re.I)
DOT = re.compile(r"(\x20+dot\x20+|\.)([A-Za-z0-9-]+)", re.I)
SIGNS = re.compile(rf"[\[({{<][\x20\t]*(?:at|dot|punkt|punto|point|arroba|@|\.)[\x20\t]*[\])}}>]|\bdot\b|\b{POINT}\x20+(?:{WORD}|[0-9])|(?<![^\W_])(?:{WORD})[\x20,.-]{{1,3}}(?:{WORD}|[0-9])|[^\x00-ɏ—‘’“”…]|[\xad¹²³]", re.I)


class Mapped:
    """A text with the source interval of each of its characters."""

    def __init__(self, text: str):
        self.text, self.starts, self.ends, self.changed = text, list(range(len(text))), list(range(1, len(text) + 1)), [False] * len(text)

    def rewrite(self, edits: list[tuple[int, int, str]]) -> None:
        """Replaces intervals, ascending and apart, by strings; each new character comes from the whole interval."""
        out, starts, ends, changed, at = [], [], [], [], 0
        for s, e, new in edits:
            if s < at or s == e:
                continue
            for whole, part in ((out, self.text[at:s]), (starts, self.starts[at:s]), (ends, self.ends[at:s]), (changed, self.changed[at:s])):
                whole += part
            out += new
            starts += [self.starts[s]] * len(new)
            ends += [self.ends[e - 1]] * len(new)
            changed += [True] * len(new)
            at = e
        self.text = "".join(out) + self.text[at:]
        self.starts, self.ends, self.changed = starts + self.starts[at:], ends + self.ends[at:], changed + self.changed[at:]


def _plain_letter(c: str) -> str | None:
    """What a single character stands for, if for something else."""
    if c in INVISIBLE:
        return ""
    if c in LOOKALIKES:
        return LOOKALIKES[c]
    if c > "ɏ" and (folded := unicodedata.normalize("NFKC", c)) != c and folded.isascii() and len(folded) == 1:
        return folded
    if c > "ɏ" and c.isdecimal():
        return str(unicodedata.decimal(c))
    return None


def transduce(text: str) -> Mapped:
    """The text without disguises."""
    out = Mapped(text)
    if not text.isascii():
        known = {c: _plain_letter(c) for c in set(text) if not c.isascii()}
        if any(v is not None for v in known.values()):
            out.rewrite([(i, i + 1, known[c]) for i, c in enumerate(text) if known.get(c) is not None])
    out.rewrite([(m.start(), m.end(), "@" if m[1].lower() in ("at", "arroba", "@") else ".") for m in DIRECT.finditer(out.text)])
    edits = []
    for m in PLAIN.finditer(out.text):  # signs in brackets are @ and . by now, and marked
        dots = list(DOT.finditer(out.text, m.end(1), m.end()))
        while dots and dots[-1][1] != "." and dots[-1][2].lower() not in ENDINGS:  # words alone are no disguise: the last one must end a host's name
            dots.pop()
        spelled = [(d.start(1), d.end(1), ".") for d in dots if d[1] != "."]
        if m[1] != "@" and (spelled or any(out.changed[d.start(1)] for d in dots)):  # a plain "at" counts only with a dot in disguise
            edits.append((m.start(1), m.end(1), "@"))
        elif m[1] != "@":
            continue
        edits += spelled
    out.rewrite(edits)
    edits = []
    for m in QUAD.finditer(out.text):
        for x in PART.finditer(out.text, m.start(), m.end()):
            if x[1]:
                edits.append((x.start(), x.end(), "."))
            elif not x[2].isdigit():
                edits.append((x.start(), x.end(), "".join(SPELLED.get(w[0].lower(), w[0]) for w in ONE.finditer(out.text, x.start(), x.end()))))
    out.rewrite(edits)
    edits = []
    for m in RUN.finditer(out.text):
        digits = "".join(SPELLED.get(w[0].lower(), w[0]) for w in ONE.finditer(out.text, m.start(), m.end()))
        edits.append((m.start(), m.end(), digits))
    out.rewrite(edits)
    return out


def scan_text(text: str | None) -> tuple[list[Span], list[Span]]:
    """Base spans, and those that only the rewritten text shows."""
    text = text or ""
    base = detect(text)
    if not SIGNS.search(text):
        return base, []
    plain = transduce(text)
    if plain.text == text:
        return base, []
    order = sorted((s, e) for _, s, e in base)
    more, starts, reach = [], [s for s, _ in order], list(accumulate((e for _, e in order), max))
    for kind, s, e in detect(plain.text):
        a, b = min(plain.starts[s:e]), max(plain.ends[s:e])
        if any(plain.changed[s:e]) or b - a > e - s:  # longer: something vanished inside
            i = bisect_right(starts, a)
            if not i or reach[i - 1] < b:
                more.append((kind, a, b))
    return base, sorted(set(more))


def written(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in spans)


def scan_pii(docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per document: doc_id, and spans ARRAY<STRUCT<kind, start, end, base>> by kind, then start; code points, end exclusive. No shuffle."""

    def run(columns: list[list]) -> list[list]:
        out = []
        for text in columns[1]:
            base, more = scan_text(text)
            out.append([{"kind": KINDS[k], "start": s, "end": e, "base": b} for k, s, e, b in sorted([(*x, True) for x in base] + [(*x, False) for x in more])])
        return [columns[0], out]

    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())]))
    return map_rows(id_and_text(docs, id_column, text_column), run, "doc_id long, spans array<struct<kind:string,start:long,end:long,base:boolean>>", [pa.int64(), kind])


def digest(spans: DataFrame) -> DataFrame:
    """The columns of op9 from scan_pii()'s spans."""
    base = F.filter("spans", lambda s: s["base"])
    line = lambda x: F.array_join(F.transform(x, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    of = lambda kind: F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long")
    return spans.select("doc_id", *(of(k).alias(f"n_{k}") for k in KINDS), F.sha2(line(base), 256).alias("base_sha256"), line(F.col("spans")).alias("spans"))
