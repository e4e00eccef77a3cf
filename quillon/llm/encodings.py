"""Text decoded with the wrong character encoding: found, and restored where it can be.

A wrong decoding is a substitution cipher: each symbol that is shown, one character or the several that
the bytes of one letter show as, stands for a letter. Every suspected swap of code pages is a source of
ciphered words; one more source stands for swaps of unknown pages, and one for UTF-8
of which only some bytes are left. Expectation-maximisation over the different words of the corpus estimates together

* the bigram model of the languages, without the words in so far as they are held to be ciphered,
* how often each source occurs, and
* the table of each source: which letter each of its symbols stands for, told by the letters
  around it. The two pages of a suspected swap only say where its table starts; the table of the unknown
  source starts from nothing.

A word is ciphered if the source's reading, weighed by how rare the source is, beats
the text as it stands under the bigram model. Tables are applied as translations, those of
symbols of several characters by pattern.
"""

from __future__ import annotations

import codecs
import math
import re
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.runtime import bounded, stage

#: Code pages a text can be shown in, each with what its bytes may truly have been.
SWAPS: Mapping[str, Sequence[str]] = {
    "cp1252": ("utf-8", "mac_roman", "cp437", "cp850", "cp1251", "koi8_r", "cp866", "cp932", "euc_jp"),
    "latin-1": ("utf-8", "cp932", "euc_jp", "koi8_r"),
    "mac_roman": ("utf-8", "cp1252", "cp1251", "cp932", "euc_jp"),
    "cp437": ("utf-8", "cp1252", "cp1251"),
    "cp850": ("utf-8", "cp1252", "cp1251"),
    "cp1251": ("utf-8", "cp1252", "koi8_r", "cp866", "mac_cyrillic"),
    "koi8_r": ("utf-8", "cp1251", "cp1252"),
    "cp866": ("utf-8", "cp1251", "koi8_r"),
    "cp1250": ("utf-8", "cp1252"),
}
MULTI = ("utf-8", "cp932", "euc_jp")
#: The source of swaps between pages that are not known.
UNKNOWN = ("unknown", "learned")
#: UTF-8 shown byte by byte, with the bytes that show as controls or blanks dropped.
LOST = ("latin-1", "utf-8 without controls")
#: Characters no correct text holds: the replacement sign and C1 controls but for next line.
BROKEN = re.compile("[�\x80-\x84\x86-\x9f]")
_HIGH = re.compile("[^\x00-\x7f]+")
_UTF8 = re.compile(rb"[\xc2-\xdf][\x80-\xbf]|[\xe0-\xef][\x80-\xbf]{2}|[\xf0-\xf4][\x80-\xbf]{3}")
EDGE = " "


def _left_of() -> dict[str, list[str]]:
    """Of each sign that is the first byte of a letter or mark in UTF-8 and the only one to show, those letters and marks."""
    found: dict[str, list[str]] = {}
    for o in [*range(0x80, 0x600), *range(0x2000, 0x2070)]:
        if unicodedata.category(chr(o))[0] in "LP":
            lead, *rest = chr(o).encode("utf-8")
            if all(b < 0xA1 or b == 0xAD for b in rest):
                found.setdefault(chr(lead), []).append(chr(o))
    return found


LEFT_OF = _left_of()


def _page(codec: str) -> dict[str, int]:
    """Character to byte of a single-byte page; bytes the page leaves open stand for their C1 control."""
    page = {}
    for b in range(256):
        try:
            page[bytes([b]).decode(codec)] = b
        except UnicodeDecodeError:
            page[chr(b)] = b
    return page


PAGES = {name: _page(name) for name in SWAPS}
SOURCES = [(shown, true) for shown, trues in SWAPS.items() for true in trues]


def _table(shown: str, true: str) -> dict[int, str]:
    """The cipher of a swap of single-byte pages, for ``str.translate``."""
    back = {b: c for c, b in _page(true).items()}
    return {ord(c): back[b] for c, b in PAGES[shown].items() if b > 127 and back[b] != c}


PAGE_SETS = {name: frozenset(page) for name, page in PAGES.items()}
TABLES = {(shown, true): _table(shown, true) for shown, true in SOURCES if true not in MULTI}


def _shapes() -> tuple[re.Pattern, re.Pattern]:
    """Sequences shaped as UTF-8 in some page, hardly ever correct text, and a quick test for them.

    Russian letters do follow each other so, and are left out.
    """
    found, leads, rests = [], "", ""
    for name in ("cp1252", "latin-1", "mac_roman", "cp437", "cp850", "cp1250", "cp1251"):
        shown = {b: re.escape(c) for c, b in PAGES[name].items() if c not in "Ёё"}
        part = lambda a, z, shown=shown: "".join(shown[b] for b in range(a, z) if b in shown)
        more = f"[{part(0x80, 0xC0)}]"
        found += [f"[{part(0xE0, 0xF0)}]{more}{more}", f"[{part(0xC2, 0xE0)}]{more}"]
        leads, rests = leads + part(0xC2, 0xF0), rests + part(0x80, 0xC0)
    return re.compile("|".join(dict.fromkeys(found))), re.compile(f"[{leads}][{rests}]")


SHAPED, _MAYBE_SHAPED = _shapes()


def words_beyond_ascii(text: str) -> Iterator[tuple[int, int]]:
    """(start, end) of the words between ASCII blanks that hold a character beyond ASCII."""
    flat, end = text.replace("\n", " ").replace("\r", " ").replace("\t", " "), -1
    for m in _HIGH.finditer(flat):
        if m.start() < end:
            continue
        start = flat.rfind(" ", 0, m.start()) + 1
        end = flat.find(" ", m.end())
        end = len(flat) if end < 0 else end
        yield start, end


def kind(c: str) -> str:
    """The class of a character: the letters of large scripts stand together, other characters are kept."""
    o = ord(c)
    if o < 0x3041:
        return c
    if o < 0x30A0:
        return "ひ"
    if o < 0x3100:
        return "カ"
    if 0x3400 <= o < 0xA000 or 0xF900 <= o < 0xFB00 or o >= 0x20000:
        return "漢"
    return c


def group(c: str) -> str:
    """A coarser class, for contexts that were never seen."""
    if c == EDGE:
        return "edge"
    if c in "ひカ漢":
        return c
    name = unicodedata.category(c)
    script = "a" if c < "\x80" else "l" if c < "ɐ" else "c" if "Ѐ" <= c < "԰" else "o"
    return (name if name[0] == "L" else name[0]) + script


def unlikely(a: str, b: str) -> bool:
    """Whether b after a mixes scripts or letters and signs within a word, or is an accented capital after a small letter."""
    latin_a, latin_b = a.isalpha() and a < "ɐ", b.isalpha() and b < "ɐ"
    if latin_a and b > "\x7f":
        return (not latin_b and unicodedata.category(b)[0] != "P") or (a.islower() and b.isupper())
    return latin_b and a > "\x7f" and not latin_a and unicodedata.category(a)[0] != "P"


#: Unlikely pairs no more frequent than this among all characters are taken for text yet to be found.
NOISE = 2e-7
#: Pages of the same letters: words in capitals look alike in them, so more is asked of each word.
CYRILLIC = ("cp1251", "koi8_r", "cp866", "mac_cyrillic")


@dataclass
class Bigrams:
    """Smoothed log probabilities of a character after another, from corpus counts."""

    pairs: Counter
    singles: Counter
    weight: float = 20.0
    known: dict = field(default_factory=dict)

    def __post_init__(self) -> None:
        self.left, self.groups, self.group_left = Counter(), Counter(), Counter()
        for (a, b), n in self.pairs.items():
            self.left[a] += n
            self.groups[group(a), b] += n
            self.group_left[group(a)] += n
        self.of_kind = Counter()
        for c, n in self.singles.items():
            self.of_kind[kind(c)] += n
        self.all = max(1, sum(self.of_kind.values()))
        self.right = Counter()
        for (_, b), n in self.pairs.items():
            self.right[b] += n

    def _one(self, a: str, c: str) -> float:
        b = kind(c)
        g = group(a)
        pair, by_group = self.pairs[a, b], self.groups[g, b]
        if unlikely(a, b):  # so few as this may all come from text yet to be found
            pair = max(0.0, pair - 3 - NOISE * self.all)
            by_group = max(0.0, by_group - 3 - NOISE * self.all)
        base = (self.right[b] + 0.2) / (self.all + 2000)
        back = (by_group + 50 * base) / (self.group_left[g] + 50)
        p = (pair + self.weight * back) / (self.left[a] + self.weight)
        if b != c:
            p *= (self.singles[c] + 0.05) / (self.of_kind[b] + 200)
        return math.log(max(p, 1e-12))

    def step(self, a: str, c: str) -> float:
        """Log probability of a character after one of class ``a``."""
        got = self.known.get((a, c))
        if got is None:
            got = self.known[a, c] = self._one(a, c)
        return got

    def score(self, word: str) -> float:
        """Log probability of a word between blanks."""
        total, a, known = 0.0, EDGE, self.known
        for c in word:
            got = known.get((a, c))
            if got is None:
                got = known[a, c] = self._one(a, c)
            total += got
            a = kind(c)
        got = known.get((a, EDGE))
        if got is None:
            got = known[a, EDGE] = self._one(a, EDGE)
        return total + got

    def rarest(self, word: str) -> float:
        """Log probability of the least likely step at a character beyond ASCII."""
        low, a = 0.0, EDGE
        for c in word + EDGE:
            if c > "\x7f" or a > "\x7f":
                got = self.known.get((a, c))
                if got is None:
                    got = self.known[a, c] = self._one(a, c)
                low = min(low, got)
            a = kind(c)
        return low


def _utf8(word: str, shown: str) -> str | None:
    """The word with its well-formed UTF-8 sequences decoded."""
    page, hit = PAGES[shown], False

    def run(m: re.Match) -> str:
        nonlocal hit
        try:
            raw = bytes(page[c] for c in m[0])
        except KeyError:
            return m[0]
        out, last = [], 0
        for seq in _UTF8.finditer(raw):
            try:
                text = seq[0].decode("utf-8")
            except UnicodeDecodeError:
                continue
            out += [m[0][last : seq.start()], text]
            last, hit = seq.end(), True
        return "".join([*out, m[0][last:]])

    out = _HIGH.sub(run, word)
    return out if hit else None


def _several(word: str, shown: str, true: str) -> tuple[str, int] | None:
    """The letters of several bytes each that a word of the page shows, and where its end begins that is cut off and shows none; None if it cannot be read."""
    page = PAGES[shown]
    raw = bytes([page[c] for c in word])
    try:
        return raw.decode(true), len(raw)
    except UnicodeDecodeError as e:
        if e.start < len(raw) - 2 or e.start < 4:
            return None
        return raw[: e.start].decode(true), e.start


def decipher(word: str, shown: str, true: str) -> str | None:
    """The word as the source reads it, None if it cannot."""
    if true != "utf-8" and not PAGE_SETS[shown].issuperset(word):
        return None
    if true == "utf-8":
        return _utf8(word, shown)
    if true in MULTI:
        read = _several(word, shown, true)
        return None if read is None else read[0] + word[read[1] :]
    get = TABLES[shown, true].get
    return "".join([get(o, c) if (o := ord(c)) > 127 else c for c in word])


def symbols(word: str, shown: str, true: str) -> list[tuple[str, str]] | None:
    """(symbol, letter) of the parts of a word as the two pages of a source read it, None if they cannot."""
    if true == "utf-8":
        page, out, last = PAGES[shown], [], 0
        for m in _HIGH.finditer(word):
            out += zip(word[last : m.start()], word[last : m.start()], strict=True)
            last, at, raw = m.end(), 0, bytes(page.get(c, 0) for c in m[0])
            for seq in _UTF8.finditer(raw):
                try:
                    letter = seq[0].decode("utf-8")
                except UnicodeDecodeError:
                    continue
                out += [*zip(m[0][at : seq.start()], m[0][at : seq.start()], strict=True), (m[0][seq.start() : seq.end()], letter)]
                at = seq.end()
            out += zip(m[0][at:], m[0][at:], strict=True)
        return [*out, *zip(word[last:], word[last:], strict=True)]
    text = decipher(word, shown, true)
    if text is None:
        return None
    if true not in MULTI:
        return list(zip(word, text, strict=True))
    out, at, end = [], 0, _several(word, shown, true)[1]
    decoder = codecs.getincrementaldecoder(true)()
    for k, c in enumerate(word[:end], 1):
        if letter := decoder.decode(bytes([PAGES[shown][c]])):
            out.append((word[at:k], letter))
            at = k
    return [*out, *zip(word[end:], word[end:], strict=True)]  # an end that is cut off stands for itself


def learn_table(
    contexts: Mapping[tuple[str, str, str], float],
    bigrams: Bigrams,
    start: Mapping[str, str] | None = None,
    *,
    rounds: int = 30,
    least: int = 5,
    sure: float = 0.7,
    odds: float = 20.0,
) -> dict[str, str]:
    """The letter each symbol stands for, by EM over (left, symbol, right) counts against the bigram model.

    ``start`` gives letters to start from, held to be as likely as all others together; the table of a source without them starts
    from nothing, and its neighbours may be symbols themselves, which then count as what they are believed to be. A
    symbol is in the table if it occurs ``least`` times in three contexts (with a start, in any), one letter has a
    probability of ``sure``, and that letter beats the symbol itself, where it is one character, by ``odds``.
    """
    start = start or {}
    total: Counter = Counter()
    different: dict[str, set] = {}
    for (a, symbol, b), n in contexts.items():
        total[symbol] += n
        different.setdefault(symbol, set()).add((a, b))
    symbols_ = sorted(x for x, n in total.items() if n >= least and (x in start or len(different[x]) >= 3))
    # bytes up to 127 mean the same in almost all pages, so no symbol stands for a plain letter
    common = [c for c, n in bigrams.singles.most_common(400) if c.isalpha() and c > "\x7f" and kind(c) == c and c not in "ひカ漢" and (start or c < "\u0250")]
    letters = sorted({*common, *(start[x] for x in symbols_ if x in start)})
    if not symbols_ or not letters:
        return {}
    at = {x: k for k, x in enumerate(symbols_)}
    to = {c: k for k, c in enumerate(letters)}
    rows = [(a, x, b, n) for (a, x, b), n in contexts.items() if x in at]
    shown = np.full((len(at), len(letters)), 1 / len(at))  # how often a letter shows as each symbol
    means = np.full((len(at), len(letters)), 1 / len(letters))  # how often a symbol means each letter
    for x, c in start.items():
        if x in at:
            shown[at[x]] /= len(letters)
            shown[at[x], to[c]] = 1.0
    open_ = set() if start else set(at)
    lefts, rights = sorted({r[0] for r in rows} - open_), sorted({r[2] for r in rows} - open_)
    rate = lambda a, c: math.exp(bigrams.step(kind(a), c))
    step = np.array([[rate(a, c) for c in letters] for a in lefts]).reshape(-1, len(letters))
    back = np.array([[rate(c, b) for c in letters] for b in rights]).reshape(-1, len(letters))
    between = np.array([[rate(a, c) for c in letters] for a in letters]) if open_ else None
    in_at, out_at = {a: k for k, a in enumerate(lefts)}, {b: k for k, b in enumerate(rights)}
    owner, n = np.array([at[r[1]] for r in rows]), np.array([r[3] for r in rows], float)
    for _ in range(rounds):
        left = np.array([step[in_at[r[0]]] if r[0] in in_at else means[at[r[0]]] @ between for r in rows])
        right = np.array([back[out_at[r[2]]] if r[2] in out_at else between @ means[at[r[2]]] for r in rows])
        posterior = shown[owner] * left * right
        posterior *= (n / np.maximum(posterior.sum(1), 1e-300))[:, None]
        counts = np.zeros_like(means)
        np.add.at(counts, owner, posterior)
        before, means = means, counts / np.maximum(counts.sum(1, keepdims=True), 1e-300)
        shown = (counts + 0.01) / (counts + 0.01).sum(0, keepdims=True)
        if np.abs(means - before).max() < 1e-3:
            break
    gain, over = Counter(), Counter()  # over the symbol itself; over the start, each context counted once
    fits = lambda a, c, b: bigrams.step(kind(a), c) + bigrams.step(kind(c), b)
    for a, x, b, m in rows:
        c = letters[int(means[at[x]].argmax())]
        if len(x) == 1 and a not in open_ and b not in open_:
            gain[x] += m * (fits(a, c, b) - fits(a, x, b))
        if x in start:
            over[x] += fits(a, c, b) - fits(a, start[x], b)
    table = {}
    for x, k in at.items():
        c = letters[int(means[k].argmax())]
        told = means[k].max() >= sure and (len(x) > 1 or gain[x] > odds)
        # against its two pages a symbol is read on far more evidence only
        if told and (not start or c == start[x] or total[x] >= 10 * least and over[x] > odds and means[k].max() >= 0.99):
            table[x] = c
    return table


@dataclass
class Cipher:
    """What EM learned: the bigram model, the log prior of each source, and the table of each source; symbols it has too little text of are read as the pages say."""

    bigrams: Bigrams
    priors: dict[tuple[str, str], float]
    tables: dict[tuple[str, str], dict[str, str]] = field(default_factory=dict)

    def __post_init__(self) -> None:
        self.unknown = str.maketrans(self.tables.get(UNKNOWN, {}))
        self.single = {s: TABLES[s] | str.maketrans(self.tables.get(s, {})) for s in TABLES}
        #: letters of symbols of several characters that are not those of the pages
        self.changed = {s: t for s, t in self.tables.items() if s[1] in MULTI and any((symbols(x, *s) or [(x, None)])[0][1] != c for x, c in t.items())}

    def deciphered(self, word: str, source: tuple[str, str]) -> str | None:
        """The word as the table of a source reads it, None if it cannot."""
        if source[1] not in MULTI:
            return word.translate(self.single[source]) if PAGE_SETS[source[0]].issuperset(word) else None
        text = decipher(word, *source)
        if text is not None and source in self.changed:
            text = "".join([self.changed[source].get(a, b) for a, b in symbols(word, *source)])
        return text

    def read(self, word: str) -> tuple[float, tuple[str, str] | None, str, float]:
        """(log odds before the prior, source, reading, most) of the likeliest source; odds of 0 if the word is better as it is. ``most`` are the highest odds of any, also below 0."""
        got, score, most = (0.0, None, word), self.bigrams.score, -math.inf
        if self.bigrams.rarest(word) >= -6.5:
            return *got, most
        base, best = score(word), -math.inf
        shaped = SHAPED.search(word) or word[0] > "\u03ff" or not PAGE_SETS["latin-1"].issuperset(word)
        for source in SOURCES:
            if source[1] == "utf-8" and not shaped:
                continue
            text = self.deciphered(word, source)
            if text is None or text == word:
                continue
            while source[1] == "utf-8" and not text.isascii():  # decoded wrongly more than once
                again = _utf8(text, source[0]) or _utf8(text, "cp1252") or _utf8(text, "latin-1")
                if again is None or score(again) <= score(text):
                    break
                text = again
            odds = score(text) - base
            most = max(most, odds)
            if odds > 0 and odds + self.priors[source] > best:
                got, best = (odds, source, text), odds + self.priors[source]
        if any(c in LEFT_OF for c in word):
            text = self._filled(_utf8(word, "latin-1") or word)
            odds = score(text) - base
            if text != word and odds > 0 and odds + self.priors[LOST] > best:
                got, best = (odds, LOST, text), odds + self.priors[LOST]
        if got[1] is None and self.unknown:
            text = word.translate(self.unknown)
            odds = score(text) - base
            if text != word and odds > 0:
                got = (odds, UNKNOWN, text)
        return *got, max(most, got[0]) if got[1] else most

    def learned(self, word: str, source: tuple[str, str]) -> bool:
        """Whether all letters a source reads in a word come from its learned table."""
        if source == LOST:
            return False
        table = self.tables.get(source, {})
        parts = zip(word, word.translate(self.unknown), strict=True) if source == UNKNOWN else symbols(word, *source)
        return all(x in table for x, c in parts if x != c)

    def _filled(self, word: str) -> str:
        """The word with each sign of a letter whose other bytes were dropped made the letter that fits best."""
        out, step = "", self.bigrams.step
        for k, c in enumerate(word):
            if c in LEFT_OF:
                a, b = kind(out[-1]) if out else EDGE, word[k + 1] if k + 1 < len(word) else EDGE
                c = max([c, *LEFT_OF[c]], key=lambda x: step(a, x) + step(kind(x), b))
            out += c
        return out


def _stacked(df: DataFrame, id_col: str, text_cols: Sequence[str], only_wide: bool) -> DataFrame:
    """(id, field_name, text): one row per value."""
    pairs = [F.struct(F.lit(c).alias("field_name"), F.col(f"`{c}`").cast("string").alias("text")) for c in text_cols]
    rows = df.select(F.col(f"`{id_col}`").alias("id"), F.explode(F.array(*pairs)).alias("v")).select("id", "v.field_name", "v.text")
    return rows.filter(F.col("text").rlike("[^\\x00-\\x7f]") if only_wide else F.col("text").isNotNull())


_KINDS = None


def _kinds() -> np.ndarray:
    """The class of every code point, as a code point."""
    global _KINDS
    if _KINDS is None:
        table = np.arange(0x110000, dtype=np.uint32)
        for low, high, c in ((0x3041, 0x30A0, "ひ"), (0x30A0, 0x3100, "カ"), (0x3400, 0xA000, "漢"), (0xF900, 0xFB00, "漢"), (0x20000, 0x110000, "漢")):
            table[low:high] = ord(c)
        table[[9, 10, 13]] = 32
        _KINDS = table
    return _KINDS


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b, n): pairs of character classes, and with a = -1 single characters of the large scripts; summed over a partition."""
    pairs: Counter = Counter()
    for batch in bounded(batches, "text"):
        texts = batch.column("text").to_pylist()
        for k in range(0, len(texts), 512):
            # sequences shaped as UTF-8 are left to the first round, which adds those that stand
            part = [SHAPED.sub("\n", t) if not t.isascii() and _MAYBE_SHAPED.search(t) else t for t in texts[k : k + 512]]
            points = np.frombuffer(("\n" + "\n".join(part) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)
            classes = _kinds()[points]
            a, b = classes[:-1], classes[1:]
            plain = (a | b) < 128
            n = np.bincount(a[plain] << 7 | b[plain])
            pairs.update({(k >> 7) << 32 | k & 127: int(n[k]) for k in np.flatnonzero(n).tolist()})
            code, n = np.unique(a[~plain].astype(np.uint64) << np.uint64(32) | b[~plain], return_counts=True)
            pairs.update(dict(zip(code.tolist(), n.tolist(), strict=True)))
            code, n = np.unique(points[points != classes], return_counts=True)
            pairs.update({c - (1 << 40): m for c, m in zip(code.tolist(), n.tolist(), strict=True)})
    keys = list(pairs)
    yield pa.RecordBatch.from_arrays(
        [
            pa.array([-1 if k < 0 else k >> 32 for k in keys], pa.int64()),
            pa.array([k + (1 << 40) if k < 0 else k & 0xFFFFFFFF for k in keys], pa.int64()),
            pa.array([pairs[k] for k in keys], pa.int64()),
        ],
        ["a", "b", "n"],
    )


def _model(rows: Sequence) -> tuple[Counter, Counter]:
    pairs, singles = Counter(), Counter()
    for r in rows:
        if r["a"] >= 0:
            pairs[chr(r["a"]), chr(r["b"])] += r["n"]
            if kind(chr(r["b"])) == chr(r["b"]) and chr(r["b"]) not in "ひカ漢":
                singles[chr(r["b"])] += r["n"]
        elif r["b"] not in (9, 10, 13):
            singles[chr(r["b"])] += r["n"]
    return pairs, singles


def wide_words(values: DataFrame) -> DataFrame:
    """(id, field_name, h, word): each word beyond ASCII of each value, with repeats; h is a hash of the value."""
    words = F.filter(F.split("text", "[ \\t\\r\\n]+"), lambda w: w.rlike("[^\\x00-\\x7f]"))
    return values.select("id", "field_name", F.xxhash64("text").alias("h"), F.explode(words).alias("word"))


def learn(df: DataFrame, id_col: str, text_cols: Sequence[str], *, rounds: int = 3, rare: float = 1e-4) -> tuple[Cipher, DataFrame]:
    """EM over all values of ``text_cols``: what was learned, and (word, n), the different words beyond ASCII that may be ciphered; staged.

    The texts are read once for the counts of pairs and once for the words; rounds then go over the different words, and leave out
    for the next those with log odds of less than -5 for every source, without signs between letters or signs of lost text. The driver
    gets counts of pairs of characters and of symbols between letters, as many as alphabets have.
    """
    got = _stacked(df, id_col, text_cols, False).select("text").mapInArrow(_count, "a long, b long, n long")
    pairs, singles = _model(got.groupBy("a", "b").agg(F.sum("n").alias("n")).collect())
    values = _stacked(df, id_col, text_cols, True)
    words = wide_words(values).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    # few bytes, but much work each: over all cores
    words = stage(words.repartition(max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), df.sparkSession.sparkContext.defaultParallelism)), "words")
    n_words = max(1, words.agg(F.coalesce(F.sum("n"), F.lit(1))).first()[0])
    cipher = Cipher(Bigrams(pairs, singles), dict.fromkeys([*SOURCES, LOST, UNKNOWN], math.log(10 * rare)))
    for _ in range(rounds):
        got = stage(words.mapInArrow(_expected(cipher), "what string, source string, a string, b string, c string, n double"), "expected")
        words = got.filter("what = 'open'").select(F.col("a").alias("word"), "n")
        moved = got.filter("what <> 'open'").groupBy("what", "source", "a", "b", "c").agg(F.sum("n").alias("n")).collect()
        new_pairs, new_singles, words_of = Counter(pairs), Counter(singles), Counter()
        contexts: dict[tuple, dict] = {}
        for r in moved:
            source = tuple(r["source"].split("|"))
            if r["what"] == "pair":
                new_pairs[r["a"], r["b"]] = max(0.0, new_pairs[r["a"], r["b"]] + r["n"])
            elif r["what"] == "single":
                new_singles[r["a"]] = max(0.0, new_singles[r["a"]] + r["n"])
            elif r["what"] == "context":
                contexts.setdefault(source, {})[r["a"], r["b"], r["c"]] = r["n"]
            else:
                words_of[source] += r["n"]
        bigrams = Bigrams(new_pairs, new_singles)
        tables = {UNKNOWN: learn_table(contexts.pop(UNKNOWN, {}), bigrams)}
        for source, seen in contexts.items():
            tables[source] = learn_table(seen, bigrams, {x: symbols(x, *source)[0][1] for _, x, _ in seen}, least=2)
        for a, b in [p for p in new_pairs if p[0] in tables[UNKNOWN] and p[1].isalpha() or p[1] in tables[UNKNOWN] and p[0].isalpha()]:
            del new_pairs[a, b]  # within words these are ciphers
        priors = {s: math.log(min(max((words_of[s] + 0.5) / n_words, rare / 100), 0.05)) for s in [*SOURCES, LOST]}
        cipher = Cipher(Bigrams(new_pairs, new_singles), priors | {UNKNOWN: math.log(10 * rare)}, tables)
    return cipher, words


def _signs_within(word: str) -> list[tuple[str, str, str]]:
    """(left, sign, right) of each sign between two letters that would not stand there in correct text."""
    return [(a, c, b) for a, c, b in zip(word, word[1:], word[2:], strict=False) if c > "\x7f" and a.isalpha() and b.isalpha() and unlikely(a, c)]


def _expected(cipher: Cipher):
    """What a round moves, by how likely each word is ciphered: pairs of the word away, those of its reading in, symbols between the letters read, words of each source."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        moved: Counter = Counter()

        def add(word: str, n: float) -> None:
            left = EDGE
            for c in [*word, EDGE]:
                moved["pair", "", left, kind(c), ""] += n
                if c != EDGE:
                    moved["single", "", c, "", ""] += n
                left = kind(c)

        for batch in bounded(batches, "word"):
            for word, n in zip(batch.column("word").to_pylist(), batch.column("n").to_pylist(), strict=True):
                odds, source, reading, most = cipher.read(word)
                chance = 1 / (1 + math.exp(min(50.0, -odds - cipher.priors[source]))) if source else 0.0
                shaped = SHAPED.search(word)  # such sequences were not counted
                if shaped and chance < 0.99:
                    add(word, n * (1 - chance))
                if chance > 0.01:
                    add(reading, n * chance)
                    if not shaped:
                        add(word, -n * chance)
                    name = "|".join(source)
                    moved["source", name, "", "", ""] += n * chance
                    parts = [(EDGE, EDGE), *symbols(word, *source), (EDGE, EDGE)] if source not in (LOST, UNKNOWN) else []
                    letters = [cipher.tables.get(source, {}).get(x, c) for x, c in parts]
                    if "".join(letters[1:-1]) == reading:  # not of words decoded wrongly more than once
                        for k in range(1, len(parts) - 1):
                            c = parts[k][1]
                            if parts[k][0] != c and kind(c) == c:  # letters of large scripts are not told apart by their neighbours
                                moved["context", name, kind(letters[k - 1][-1:] or EDGE), parts[k][0], kind(letters[k + 1][:1] or EDGE)] += n * chance
                signs = _signs_within(word)
                if chance < 0.5 or source == UNKNOWN:
                    for a, c, b in signs:
                        moved["context", "|".join(UNKNOWN), a, c, b] += n
                if signs or shaped or most > -5 or BROKEN.search(word):
                    moved["open", "", word, "", ""] = n
        keys = list(moved)
        yield pa.RecordBatch.from_arrays(
            [*(pa.array([k[j] for k in keys], pa.string()) for j in range(5)), pa.array([moved[k] for k in keys], pa.float64())], ["what", "source", "a", "b", "c", "n"]
        )

    return run


def _readings(cipher: Cipher, near: float) -> Callable:
    """(word, source, odds, reading, learned) of the words some source reads better, and without a source of those that hold a :data:`BROKEN` sign."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, "word"):
            out = []
            for word in batch.column("word").to_pylist():
                odds, source, reading, _ = cipher.read(word)
                if source and odds > (4 * near if source[0] in CYRILLIC and source[1] in CYRILLIC else near):
                    out.append((word, "|".join(source), odds, reading, cipher.learned(word, source)))
                if BROKEN.search(word):
                    out.append((word, None, 0.0, word, False))
            columns = list(zip(*out, strict=True)) or [[]] * 5
            kinds = (pa.string(), pa.string(), pa.float64(), pa.string(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["word", "source", "odds", "reading", "learned"])

    return run


def ciphered_words(df: DataFrame, id_col: str, text_cols: Sequence[str], learned: tuple[Cipher, DataFrame] | None = None, near: float = 2.0, rare: float = 1e-4) -> DataFrame:
    """(id, field_name, h, word, source, reading, learned): the words of each value held to be ciphered, without a source where nothing can be told.

    A source must outweigh its prior, the share of the values that it has, with the different words of the value it explains better by more
    than ``near``; each of these is then taken to be ciphered. Only words that some source reads better are joined to the values.
    """
    cipher, words = learned or learn(df, id_col, text_cols)
    readings = stage(words.mapInArrow(_readings(cipher, near), "word string, source string, odds double, reading string, learned boolean"), "readings")
    key = ["id", "field_name", "h"]
    hits = stage(wide_words(_stacked(df, id_col, text_cols, True)).join(readings, "word").distinct(), "hits")
    weight = hits.filter("source is not null").groupBy(*key, "source").agg(F.sum(F.col("odds") - near).alias("weight"))
    weight = stage(weight.filter(F.col("weight") + near + math.log(0.05) > 0), "weights")
    n_values = max(1, _stacked(df, id_col, text_cols, True).count())
    prior = dict.fromkeys(["|".join(s) for s in cipher.priors], math.log(rare))
    for last in (False, True):
        of = F.create_map(*[F.lit(v) for s, p in prior.items() for v in (s, p)])
        sure = weight.filter(F.col("weight") + near + of[F.col("source")] > 0)
        if not last:  # how many values each source has
            held = {r["source"]: r["n"] for r in sure.groupBy("source").agg(F.count(F.lit(1)).alias("n")).collect()}
            prior = {s: math.log(min(max((held.get(s, 0) + 0.5) / n_values, rare / 10), 0.05)) for s in prior}
    sure = sure.select(*[F.col(c).alias(f"s_{c}") for c in [*key, "source"]])
    same = [F.col(c).eqNullSafe(F.col(f"s_{c}")) for c in [*key, "source"]]
    told = hits.join(sure, same, "left_semi")
    return told.unionByName(hits.filter("source is null")).drop("odds")


def _values_of(df: DataFrame, id_col: str, text_cols: Sequence[str], found: DataFrame, how: str) -> DataFrame:
    """The values (id, field_name, text) joined to rows of (id, field_name, h, ...)."""
    keys = ("id", "field_name", "h")
    values = _stacked(df, id_col, text_cols, True).withColumn("h", F.xxhash64("text"))
    return values.join(found.withColumnsRenamed({c: f"f_{c}" for c in keys}), [F.col(c).eqNullSafe(F.col(f"f_{c}")) for c in keys], how)


def found(df: DataFrame, id_col: str, text_cols: Sequence[str], learned: tuple[Cipher, DataFrame] | None = None) -> DataFrame:
    """(id, field_name): one row per value that holds wrongly decoded text, as :func:`garbled` without the restored text."""
    words = ciphered_words(df, id_col, text_cols, learned)
    return _values_of(df, id_col, text_cols, words.select("id", "field_name", "h"), "left_semi").select(F.col("id").alias(id_col), "field_name")


def garbled(df: DataFrame, id_col: str, text_cols: Sequence[str], learned: tuple[Cipher, DataFrame] | None = None) -> DataFrame:
    """(id, field_name, sources, learned, restored, complete): one row per value that holds wrongly decoded text.

    ``restored`` is the value with every word put right that can be; ``learned`` tells whether all its letters came
    from tables as they were learned, and ``complete``
    is false where signs of a lost original remain, as U+FFFD. Null, empty and correct
    values give no row; each repeated row gives its own. Values are read whole.
    """
    words = ciphered_words(df, id_col, text_cols, learned)
    words = words.groupBy("id", "field_name", "h").agg(F.collect_list(F.struct("word", "source", "reading", "learned")).alias("words"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, "text"):
            restored, complete, sources, sure = [], [], [], []
            for text, told in zip(batch.column("text").to_pylist(), batch.column("words").to_pylist(), strict=True):
                reading = {w["word"]: w["reading"] for w in sorted(told, key=lambda w: w["source"] is not None)}
                out, last = [], 0
                for a, b in words_beyond_ascii(text):
                    if text[a:b] in reading:
                        out += [text[last:a], reading[text[a:b]]]
                        last = b
                out = "".join([*out, text[last:]])
                restored.append(out), complete.append(not BROKEN.search(out))
                sources.append(sorted({" as ".join(w["source"].split("|")[::-1]) for w in told if w["source"]}))
                sure.append(all(w["learned"] for w in told))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id"), batch.column("field_name"), pa.array(sources, pa.list_(pa.string())), pa.array(sure, pa.bool_()),
                    pa.array(restored, pa.string()), pa.array(complete, pa.bool_()),
                ],
                ["id", "field_name", "sources", "learned", "restored", "complete"],
            )

    rows = _values_of(df, id_col, text_cols, words, "inner").select("id", "field_name", "text", "words")
    schema = f"id {rows.schema['id'].dataType.simpleString()}, field_name string, sources array<string>, learned boolean, restored string, complete boolean"
    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_col)
