"""Sentence units of texts in many languages by cascading tables of break and no-break rules.

A text is cut into lines first; within a line every place after a sentence mark (with the
closing quotes and brackets behind it), and every blank between two Thai letters, is a candidate. The tables of a language's
cascade are tried in order, and in each the rules in order; a rule has a pattern for what stands
before the place and one for what stands after, and the first rule whose two patterns
match decides. Each language has tables of its own abbreviations and ordinals. Since labels can be wrong and texts quote
each other, the tables of the other languages follow, without what is an ordinary word of the language.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterable, Iterator, Mapping, Sequence
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.runtime import bounded

#: Abbreviations of each language, by what they stand before: "name", "count" a number, "inner" the rest of a phrase, never its
#: end, "last" perhaps the end of a sentence; "after_ordinal" are words that follow the dot of an ordinal number.
ABBREVIATIONS: dict[str, dict[str, str]] = {
    "en": {
        "name": "Mr Mrs Ms Mx Messrs Dr Drs Prof St Ste Mt Rev Hon Gen Col Capt Lt Sgt Sen Rep Gov Pres feat ft",
        "count": "No no Nos nos vol Vol vols fig Fig figs ch Ch sec Sec cat Cat p pp P approx Approx Jan Feb Mar Apr Jun Jul Aug Sep Sept Oct Nov Dec",
        "inner": "e.g i.e cf viz vs al cit",
        "last": "etc p.m a.m P.M A.M Jr jr Inc Ltd Co Corp Bros min max hr hrs sec U.K U.S U.N E.U D.C",
    },
    "es": {
        "name": "Sr Sra Srta Srs Dra D Dª Ud Uds Lic Ing",
        "count": "Núm núm num Num n.º N.º nº art Art pág Pág aprox Aprox cap Cap ene abr ago dic",
        "inner": "p.ej p ej a.C d.C",
        "last": "EE UU ee uu Cía Cia",
    },
    "fr": {"name": "M MM Mme Mmes Mlle Pr", "count": "env Env art Art janv févr avr juil déc", "inner": "p.ex ex", "last": "etc"},
    "de": {
        "name": "Hr Fr Frl Hrn Dipl Ing Abg bzw Hl hl",
        "count": "Nr nr S s Bd bd Abb abb Kap kap ca Ca c ungef etwa",
        "inner": "z.B z d.h d u.a u n.Chr v.Chr",
        "last": "usw",
        "after_ordinal": "Januar Jänner Februar März April Mai Juni Juli August September Oktober November Dezember Jahrhundert Jahrestag Stock Etage Auflage Klasse Platz Mal",
    },
    "it": {"name": "Sig sig.ra sig.na Sig.ra Sig.na sig dott Dott dott.ssa Dott.ssa avv Avv ing prof", "count": "pag Pag circa cap Cap gen mag giu lug set ott", "inner": "ad es", "last": "ecc"},
    "pt": {"count": "nº pg tom Tom fev mai", "inner": "p.ex ex", "last": "Cia"},
    "ru": {"name": "гр г-н им ул пр акад проф тов св о", "count": "т стр рис гл разд ст № прим п", "inner": "т.е т.к т напр см ср", "last": "и.т.д т.д т.п д п др пр"},
    "hi": {"name": "श्री श्रीमती डॉ पं प्रो"},
    "ar": {"name": "د أ م أ.د"},
    "nordic": {"inner": "ok op", "last": "u.s.w", "after_ordinal": "januar februar mars april mai juni juli august september oktober november desember"},
}
#: Abbreviations elsewhere that are ordinary words here, often the last of a sentence.
ORDINARY: dict[str, str] = {
    "en": "ad al ex ok ing",
    "es": "al es ex ok",
    "fr": "ad al es ok",
    "de": "ad al es ex ok im min",
    "it": "ad al ex ok",
    "pt": "al ex ok",
}

MARKS = "!?.。！？．｡।॥؟۔‼⁇⁈⁉"
CLOSERS = "\"'”’»›)\\]}」』）】》〉｣"
_QUOTES = {"“": "”", "«": "»", "‹": "›", "「": "」", "『": "』", "„": "“", "(": ")", "（": "）", "[": "]", "【": "】", "《": "》", "〈": "〉", "{": "}"}
_BRACKETS = ")）]】}"
_ENDS = frozenset(CLOSERS.replace("\\]", "]") + "“")
LINE_BREAK = regex.compile("\r\n|[\n\r\v\f\x85\u2028\u2029]")
#: A run of marks, then closing signs, each perhaps behind a blank as in French.
CANDIDATE = regex.compile(rf"[{regex.escape(MARKS)}…]+(?:[\u00a0\u202f ]?[»›]|[{CLOSERS}]|“(?=[\s,;:.]|\Z))*")
THAI_BLANK = regex.compile(r"(?<=\p{Thai})[^\S\n]+(?=\p{Thai})")
LIST_MARK = regex.compile(r"\s*(?:\(?\d{1,4}[.)]|\p{L}[.)]|[-–—•*·▪◦])(?=\s)")
_OPENING = regex.compile(r"[\"“«‹「『„(（\[【《〈{]")
BLANKS = " \t\x1c\x1d\x1e\x1f\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u200b\u202f\u205f\u3000\ufeff"


@dataclass(frozen=True)
class Rule:
    """Break, or not, where ``before`` matches up to the place and ``after`` from it on; tried at places of the kind ``at`` only."""

    breaks: bool
    before: regex.Pattern
    after: regex.Pattern
    at: str = "mark"


def _rule(breaks: bool, before: str, after: str, at: str = "mark") -> Rule:
    return Rule(breaks, regex.compile(rf"(?:{before})\Z"), regex.compile(after), at)


def _words(words: Iterable[str]) -> str:
    """Any of the abbreviations with its dot, also with a capital, as at the start of a sentence; a blank may follow a dot within."""
    words = {*words, *(w[:1].upper() + w[1:] for w in words)}
    each = (regex.escape(w).replace(r"\.", r"\.[\s\u00a0\u202f]?") for w in sorted(words, key=lambda w: (-len(w), w)))
    return rf"(?<![\p{{L}}\p{{N}}])(?:{'|'.join(each)})\."


_OPEN = r"[\"'“«‹「『„(（\[【¿¡]"
_ANY = ""
_UPPER = rf"\s*{_OPEN}*\s?[\p{{Lu}}\p{{Lt}}]"


def _table(own: Mapping[str, str], without: str = "") -> list[Rule]:
    """The rules of one language's abbreviations."""
    lists = {k: [w for w in v.split() if k == "count" or w.lower() not in without.split()] for k, v in own.items()}
    has = lambda k, breaks, after: [_rule(breaks, _words(lists[k]), after, "short")] if lists.get(k) else []
    rules = has("name", False, r"\s*[\p{L}]") + has("count", False, r"\s*[\p{N}#№]") + has("inner", False, r"\s*[^\s]")
    rules += has("last", False, r"\s*[\p{Ll},;:\-–—)]") + has("last", True, _UPPER)
    if lists.get("after_ordinal"):
        rules.append(_rule(False, r"(?<![\p{L}\p{N}.,])\d{1,2}\.", rf"\s+(?:{'|'.join(lists['after_ordinal'])})\b", "number"))
    return rules


#: Tables before those of the languages.
FIRST: list[tuple[str, list[Rule]]] = [
    ("th", [_rule(True, r"\p{Thai}", r"[^\S\n]+\p{Thai}", "blank"), _rule(False, _ANY, _ANY, "blank")]),
    ("enclosed", [_rule(False, _ANY, _ANY, "enclosed")]),  # a mark in a quotation or bracket, or a bracket within a sentence
    (
        "dots",
        [
            _rule(False, r"(?:\.{3,}|…+|\.{2,}…+)[" + CLOSERS + r"]*", _ANY, "dots"),
            _rule(False, r"[\p{L}\p{N}_]\.", r"[\p{Ll}\p{N}_/\\@-]", "joined"),  # decimals, versions, file names, addresses
            _rule(False, r"[!?]", r"[\p{Ll}\p{N}_=&/]", "joined"),
        ],
    ),
    (
        "initials",
        [
            _rule(False, r"(?<![\p{L}\p{N}])\p{Lu}\.", r"\s?-?\p{Lu}(?:\.|\p{L})", "short"),  # J. R. Smith, J.-P., U.K.
            _rule(False, r"(?<!\p{L})\p{Lu}\.-\p{Lu}\.", r"\s*\p{L}", "short"),
            _rule(False, _words(["cat", "Cat", "op"]), r"\s+(?:no|nr|n|cit)\b", "short"),
            _rule(False, _words(["EE", "ee"]), r"\s*(?:UU|uu)\b", "short"),
        ],
    ),
]
#: Tables behind those of the languages.
THEN: list[tuple[str, list[Rule]]] = [
    ("capitals", [_rule(False, r"(?:\p{Lu}\.){2,}", r"\s*[\p{Ll},;:]", "short")]),
    (
        "quotations",
        [
            _rule(False, rf"[{CLOSERS}“]", r"\s*[,;:、，；：\-–—]", "closed"),
            _rule(False, r"[」』]", r"\s*(?:と|って|っていう|という|は|が|を|に|の|も|で)", "closed"),
            _rule(False, rf"[{MARKS}][\u00a0\u202f ]?[{CLOSERS}“]+", r"\s*\p{Ll}", "closed"),
            # scripts without case: a call or question is quoted within a sentence, a full stop ends it
            _rule(False, rf"[\p{{Han}}\p{{Hiragana}}\p{{Katakana}}\p{{Devanagari}}\p{{Arabic}}\p{{Thai}}]\s?[!?！？؟]+[{CLOSERS}“]+", r"\s*\S", "closed"),
        ],
    ),
    (
        "any",
        [
            _rule(True, r"[。！？．｡।॥؟۔‼⁇⁈⁉][^\s]*", _ANY),
            _rule(True, rf"[{MARKS}][\u00a0\u202f ]?[{CLOSERS}“]*", rf"\s+{_OPEN}*\s?[\p{{Lu}}\p{{Lt}}\p{{Lo}}\p{{N}}\p{{S}}]"),
            _rule(True, rf"[{MARKS}][\u00a0\u202f ]?[{CLOSERS}“]*", rf"\s+(?:{_OPEN}|[-–—•*#…])"),
            _rule(True, r"(?:[\p{Ll}\p{Lo}\p{N}]{2}|\p{N}|[" + CLOSERS + r"])\.[" + CLOSERS + r"]*", rf"{_OPEN}?[\p{{Lu}}\p{{Lo}}]"),
            _rule(True, rf"[!?][{CLOSERS}“]*", rf"{_OPEN}?[\p{{Lu}}\p{{Lt}}\p{{Lo}}]"),
        ],
    ),
    # a small letter goes on, unless the writer starts sentences with small letters
    ("small letters", [_rule(True, _ANY, r"\s+\p{Ll}", "small")]),
]


def _parts(kinds: Sequence[str]) -> set[str]:
    """The last parts of all abbreviations, in lower case."""
    return {w.replace(".", " ").split()[-1].lower() for own in ABBREVIATIONS.values() for k in kinds for w in own.get(k, "").split()}


_SHORT = _parts(("name", "count", "inner", "last")) | {"cat", "op"}
_NEVER_LAST = _parts(("name", "inner", "last"))
#: No rule looks further back than the longest abbreviation, with blanks behind its dots, and what stands before it.
_BACK = 2 * max(len(w) for own in ABBREVIATIONS.values() for v in own.values() for w in v.split()) + 4
_TAIL = regex.compile(r"[^\s.\p{P}\p{S}]*(?=\.?\Z)")


@cache
def cascade(language: str | None) -> tuple[tuple[str, list[Rule]], ...]:
    """The tables of a language: its own first, then those of the others without its ordinary words; of no known language all alike."""
    known = language if language in ABBREVIATIONS else None
    own = [(known, _table(ABBREVIATIONS[known]))] if known else []
    rest = [v for name, v in ABBREVIATIONS.items() if name != known]
    pooled = {k: " ".join(v.get(k, "") for v in rest) for k in ("name", "count", "inner", "last", "after_ordinal")}
    others = [("others", _table(pooled, ORDINARY.get(known or "", "")))]
    return (*FIRST, *own, *others, *THEN)


@cache
def _rules(language: str | None) -> dict[frozenset[str], list[Rule]]:
    return {}


_FIRST_LETTER = regex.compile(r"\p{L}")


def _enclosed(line: str) -> list[tuple[int, int, str]]:
    """(start, end, closing sign) of quotations and brackets that are closed in the line."""
    open_, found, straight = [], [], None
    for k, c in enumerate(line):
        if c == '"':
            if straight is None:
                straight = k
            else:
                found.append((straight, k, c))
                straight = None
        elif open_ and c == open_[-1][1]:
            found.append((open_.pop()[0], k, c))
        elif c in _QUOTES:
            open_.append((k, _QUOTES[c]))
        elif c in "”»)）]】}」』》〉":
            for n in range(len(open_) - 1, -1, -1):
                if open_[n][1] == c:
                    found.append((open_[n][0], k, c))
                    del open_[n:]
                    break
    return found


def _line_breaks(line: str, language: str | None) -> Iterator[int]:
    """Offsets in a line after which a sentence ends, without the last."""
    mark = LIST_MARK.match(line)
    floor = mark.end() if mark else 0
    closed = {b: (a, c) for a, b, c in _enclosed(line)} if _OPENING.search(line) else {}
    outer: list[tuple[int, int]] = []  # quotations and brackets that lie in no other
    for a, b in sorted((a, b) for b, (a, _) in closed.items()):
        if outer and a < outer[-1][1]:
            outer[-1] = (outer[-1][0], max(b, outer[-1][1]))
        else:
            outer.append((a, b))
    starts = [a for a, _ in outer]
    start = floor  # of the sentence that is going on
    places = [m.span() for m in CANDIDATE.finditer(line, floor)]
    if "\u0e00" <= max(line):
        places = sorted([*places, *((m.start(), m.start()) for m in THAI_BLANK.finditer(line))])
    sorted_rules = _rules(language)
    for mark_at, at in places:
        if at >= len(line):
            break
        kinds = _kinds(line, mark_at, at, start, closed, outer, starts)
        rules = sorted_rules.get(kinds)
        if rules is None:
            rules = sorted_rules[kinds] = [r for _, table in cascade(language) for r in table if r.at in kinds]
        low = max(0, mark_at - _BACK)
        for rule in rules:
            if rule.after.match(line, at) and rule.before.search(line, low, at):
                if rule.breaks:
                    yield at
                    start = at
                break


def _kinds(line: str, mark_at: int, at: int, start: int, closed: dict, outer: list, starts: list) -> frozenset[str]:
    """What a place is, which says what rules can apply to it."""
    if mark_at == at:
        return frozenset(["blank"])
    k = bisect_left(starts, at - 1) - 1
    inside = k >= 0 and (at - 1 < outer[k][1] or mark_at < outer[k][1] and outer[k][0] < mark_at and outer[k][1] >= at)
    if not inside and closed:
        closing = [closed[b] for b in range(mark_at + 1, at) if b in closed]
        inside = bool(closing and all(c in _BRACKETS for _, c in closing) and line[start : closing[-1][0]].strip(BLANKS))
    if inside:
        return frozenset(["enclosed"])
    kinds = {"mark"}
    run = line[mark_at:at]
    if "…" in run or "..." in run:
        kinds.add("dots")
    if not line[at].isspace():
        kinds.add("joined")
    tail = ""
    if run == ".":
        low = max(0, mark_at - _BACK)
        tail = _TAIL.search(line, low, at)[0].lower()
        if len(tail) <= 1 or tail in _SHORT or not tail.isalpha():
            kinds.add("short")
        if line[mark_at - 1 : mark_at].isdigit():
            kinds.add("number")
    elif run[-1] in _ENDS:
        kinds.add("closed")
    first = _FIRST_LETTER.search(line, start, at)
    if first and first[0].islower() and not (run == "." and (tail in _NEVER_LAST or len(tail) == 1 and tail.isalpha())):
        kinds.add("small")
    return frozenset(kinds)


def sentence_ends(text: str, language: str | None = None) -> list[int]:
    """Number of code points from the start of the text to the end of each sentence."""
    ends, start = [], 0
    for line_end, next_start in [*((m.start(), m.end()) for m in LINE_BREAK.finditer(text)), (len(text), len(text))]:
        line = text[start:line_end]
        body = line.rstrip(BLANKS)
        if body.strip(BLANKS):
            ends += [start + k for k in _line_breaks(body, language)]
            ends.append(start + len(body))
        start = next_start
    return ends


def sentences(df: DataFrame, id_col: str, text_col: str, lang_col: str | None = None, *, with_text: bool = False) -> DataFrame:
    """(id, n, start_pos, end_pos[, sentence]): the sentences of each text in order.

    Positions count code points; ``end_pos`` takes in closing marks, quotes and
    brackets and leaves out the blanks behind, ``start_pos`` leaves out the
    blanks in front. A label in ``lang_col``, in any letter case and with or without a region, puts the tables of its language first;
    without one, or with one that is not known, all languages count alike. Null, empty and blank texts have no sentence and no row. Repeated
    rows give repeated sentences. Whole texts are read, however long.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, "_text"):
            row, number, starts, ends, parts = [], [], [], [], []
            for k, (text, language) in enumerate(zip(batch.column("_text").to_pylist(), batch.column("_lang").to_pylist(), strict=True)):
                last = 0
                for n, end in enumerate(sentence_ends(text, language) if text else []):
                    part = text[last:end]
                    begin = end - len(part.lstrip(BLANKS + "\n\r\v\f\x85\u2028\u2029"))
                    row.append(k), number.append(n), starts.append(begin), ends.append(end)
                    if with_text:
                        parts.append(text[begin:end])
                    last = end
            columns = [batch.column("_id").take(pa.array(row, pa.int64())), *(pa.array(np.array(x, np.int32)) for x in (number, starts, ends))]
            names = ["_id", "n", "start_pos", "end_pos"]
            yield pa.RecordBatch.from_arrays(
                columns + ([pa.array(parts, pa.string())] if with_text else []), names + ["sentence"] * with_text
            )

    label = F.lower(F.regexp_extract(F.col(f"`{lang_col}`").cast("string"), "[A-Za-z]+", 0)) if lang_col else F.lit(None).cast("string")
    rows = df.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").cast("string").alias("_text"), label.alias("_lang"))
    schema = f"_id {rows.schema['_id'].dataType.simpleString()}, n int, start_pos int, end_pos int" + ", sentence string" * with_text
    return rows.mapInArrow(run, schema).withColumnRenamed("_id", id_col)
