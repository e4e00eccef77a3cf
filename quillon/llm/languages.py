"""Language of each stretch of a text, and of the text, with a confidence.

The script of a word narrows its candidates; words of a script several languages
share get scores from word counts learned on labelled rows, and unknown ones a weak score
from their letters. A Viterbi pass over the words of a text, with a penalty for
each switch (lower where a line begins), labels the stretches.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.encodings import BROKEN, MULTI, SOURCES, decipher
from quillon.runtime import bounded, stage

#: The languages, in the order of the score columns.
LANGUAGES = ("en", "es", "pt", "fr", "de", "it", "ru", "ja")
#: Code point ranges of scripts that leave one candidate.
SCRIPTS = (("ru", 0x0400, 0x052F), ("ja", 0x3040, 0x30FF), ("ja", 0x31F0, 0x31FF), ("ja", 0x3400, 0x9FFF), ("ja", 0xFF66, 0xFF9F))
LATIN = tuple(k for k, x in enumerate(LANGUAGES) if x not in ("ru", "ja"))
#: Words of a text and its line breaks.
TOKEN = re.compile(r"\n|[^\W\d_]+")
FLOOR, LETTERS = -6.0, 0.25


def label_of(label: Column) -> Column:
    """The language a label names: trimmed, lower case, before any hyphen or underscore; null if missing."""
    name = F.split(F.lower(F.regexp_replace(label, r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")), "[-_]").getItem(0)
    return F.when((name != "") & (name != "und"), name)


def narrowed(word: str) -> int | None:
    """The only candidate by script, -1 for a script none of the languages has, None for Latin letters."""
    c = ord(word[0])
    for name, low, high in SCRIPTS:
        if low <= c <= high:
            return LANGUAGES.index(name)
    return None if c < 0x250 or 0x1E00 <= c < 0x1F00 else -1


@dataclass
class Model:
    """Scores of words and of letter triples, one column per language, 0 for the best."""

    words: dict[str, int]
    scores: np.ndarray
    triples: dict[str, np.ndarray] = field(default_factory=dict)
    seen: dict[str, np.ndarray] = field(default_factory=dict)

    @cached_property
    def votes(self) -> np.ndarray:
        """Whether each known word is evidence: single accented letters are not, they abound in garbled text."""
        return np.array([len(w) > 1 or w.isascii() for w in self.words], bool)

    def unknown(self, word: str) -> np.ndarray:
        """Scores of a word the model has not seen."""
        got = self.seen.get(word)
        if got is None:
            got = np.zeros(len(LANGUAGES), np.float32)
            only = narrowed(word)
            if only is not None:
                if only >= 0:  # a script none of the languages has says nothing
                    got[:] = FLOOR
                    got[only] = 0
            else:
                padded = f"^{word}$"
                rows = [self.triples[t] for t in (padded[k : k + 3] for k in range(len(padded) - 2)) if t in self.triples]
                got[:] = FLOOR
                total = np.mean(rows, axis=0) * LETTERS if rows else np.zeros(len(LANGUAGES), np.float32)
                latin = list(LATIN)
                got[latin] = total[latin] - total[latin].max()
            if len(self.seen) > 200_000:
                self.seen.clear()
            self.seen[word] = got
        return got


def _relative(counts: np.ndarray, smooth: float) -> np.ndarray:
    """Log rates of the rows against the best column; a row never seen in some columns is equally rare in all of them."""
    total = counts.sum(0, keepdims=True) + 1.0
    rate = np.log(counts / total + smooth / total.sum())
    return np.maximum(rate - rate.max(1, keepdims=True), FLOOR).astype(np.float32)


def _model(rows: Sequence, smooth: float = 2.0) -> Model:
    """From (word, language, n)."""
    names = {x: k for k, x in enumerate(LANGUAGES)}
    words: dict[str, int] = {}
    for r in rows:
        if narrowed(r["word"]) is None:
            words.setdefault(r["word"], len(words))
    counts = np.zeros((len(words) + 1, len(LANGUAGES)))
    for r in rows:
        if r["word"] in words and r["lang"] in names:
            counts[words[r["word"]], names[r["lang"]]] += r["n"]
    scores = _relative(counts, smooth)[:-1]
    latin = list(LATIN)
    scores[:, latin] -= scores[:, latin].max(1, keepdims=True)
    scores[:, [k for k in range(len(LANGUAGES)) if k not in LATIN]] = FLOOR
    triples: dict[str, np.ndarray] = {}
    for word, k in words.items():
        padded = f"^{word}$"
        for t in {padded[i : i + 3] for i in range(len(padded) - 2)}:
            triples[t] = triples.get(t, 0) + np.minimum(counts[k], 50)
    some = [t for t, c in triples.items() if c.sum() >= 5]
    table = _relative(np.array([triples[t] for t in some]).reshape(-1, len(LANGUAGES)), 5.0) if some else np.zeros((0, len(LANGUAGES)))
    return Model(words, scores, dict(zip(some, table, strict=True)))


def _viterbi(scores: np.ndarray, at: np.ndarray, length: np.ndarray, first: np.ndarray, switch: float, line_switch: float) -> np.ndarray:
    """The best language of each token; texts lie one after another from ``at``, ``first`` marks tokens that begin a line."""
    best = np.zeros(len(scores), np.int8)
    order = np.argsort(-length, kind="stable")
    order = order[length[order] > 0]
    done = 0
    while done < len(order):
        longest = int(length[order[done]])
        some = order[done : done + max(1, 1_000_000 // longest)]
        done += len(some)
        n, k = len(some), scores.shape[1]
        came = np.empty((longest, n, k), np.int8)
        total = scores[at[some]].copy()
        stay = np.arange(k, dtype=np.int8)
        live = n
        for t in range(1, longest):
            while length[some[live - 1]] <= t:
                live -= 1
            pos = at[some[:live]] + t
            now = total[:live]
            top = now.argmax(1)
            jump = now[np.arange(live), top] - np.where(first[pos], line_switch, switch)
            keep = now >= jump[:, None]
            came[t, :live] = np.where(keep, stay, top[:, None].astype(np.int8))
            total[:live] = np.where(keep, now, jump[:, None]) + scores[pos]
        state = total.argmax(1).astype(np.int8)
        live = 0
        for t in range(longest - 1, -1, -1):
            while live < n and length[some[live]] > t:
                live += 1
            best[at[some[:live]] + t] = state[:live]
            if t:
                state[:live] = came[t, np.arange(live), state[:live]]
    return best


@dataclass
class Lines:
    """Lines of a batch of texts: the text, the number in it, the language (-1 for none) and the score margin."""

    text: np.ndarray
    number: np.ndarray
    language: np.ndarray
    margin: np.ndarray
    filled: np.ndarray


def label_lines(texts: Sequence[str | None], model: Model, switch: float, line_switch: float) -> Lines:
    """Label the lines of texts. Only lines with evidence for a language have one; ``filled`` marks those not blank."""
    ids: list[int] = []
    extra: list[np.ndarray] = []
    sure: list[bool] = []  # of the words not in the model: told by their script
    length, filled = [], []
    get, base = model.words.get, len(model.words)
    for text in texts:
        text = (text or "").replace("\r\n", "\n").replace("\r", "\n")
        filled += [bool(x) and not x.isspace() for x in text.split("\n")]
        tokens = TOKEN.findall(text.lower())
        length.append(len(tokens))
        for token in tokens:
            k = get(token)
            if k is None:
                if token == "\n":
                    k = -1
                else:
                    k = base + len(extra)
                    extra.append(model.unknown(token))
                    sure.append(narrowed(token) is not None)
            ids.append(k)
    token = np.array(ids, np.int64)
    size = np.array(length, np.int64)
    table = np.concatenate([model.scores, np.array(extra, np.float32).reshape(-1, len(LANGUAGES)), np.zeros((1, len(LANGUAGES)), np.float32)])
    text_of = np.repeat(np.arange(len(size)), size)
    broken = token == -1
    # each text has one line more than breaks
    breaks_of = np.bincount(text_of[broken], minlength=len(size))
    first_line = np.concatenate([[0], np.cumsum(breaks_of + 1)])
    before = np.cumsum(broken) - broken
    start_breaks = np.concatenate([[0], np.cumsum(breaks_of)])[:-1]
    line = first_line[text_of] + before - start_breaks[text_of]
    words = ~broken
    scores, line, text_of = table[token[words]], line[words], text_of[words]
    size = np.bincount(text_of, minlength=len(size))
    at = np.cumsum(size) - size
    first = np.concatenate([[True], line[1:] != line[:-1]]) if len(line) else np.zeros(0, bool)
    best = _viterbi(scores, at, size, first, switch, line_switch)
    lines, k = int(first_line[-1]), len(LANGUAGES)
    votes = np.zeros((lines, k))
    # a known word votes for its stretch's language as far as it speaks for any language at all
    weight = np.minimum(-scores[:, list(LATIN)].min(1), 3.0) if len(scores) else np.zeros(0)
    weight = np.where((scores == FLOOR).sum(1) == k - 1, 3.0, weight)
    known = np.concatenate([model.votes, np.array(sure, bool), [False]])
    np.add.at(votes, (line, best), np.where(known[token[words]], weight, 0.0))
    sums = np.stack([np.bincount(line, scores[:, j], lines) for j in range(k)], axis=1)
    language = np.where(votes.max(1) >= 1.0, votes.argmax(1), -1)
    own = sums[np.arange(lines), np.maximum(language, 0)]
    sums[np.arange(lines), np.maximum(language, 0)] = -np.inf
    number = np.arange(lines) - np.repeat(first_line[:-1], breaks_of + 1)
    return Lines(np.repeat(np.arange(len(size)), breaks_of + 1), number, language, own - sums.max(1), np.array(filled, bool))


def readings(text: str) -> list[str]:
    """What a text says if it was decoded with a wrong code page, by each swap that can be undone line by line."""
    found = {}
    # what decodes as several bytes a letter hardly ever does so by chance
    for shown, true in sorted(SOURCES, key=lambda source: source[1] not in MULTI):
        lines = [decipher(x, shown, true) if x and not x.isascii() else x for x in text.split("\n")]
        reading = "\n".join(x if y is None else y for x, y in zip(text.split("\n"), lines, strict=True))
        if reading != text:
            found[reading] = None
    return list(found)


def label_texts(texts: Sequence[str | None], model: Model, switch: float, line_switch: float) -> Lines:
    """:func:`label_lines`, but a text with many lines that say nothing is labelled by the reading of it that says most."""
    got = label_lines(texts, model, switch, line_switch)
    n = len(texts)
    filled = np.bincount(got.text[got.filled], minlength=n)
    known = np.bincount(got.text[got.language >= 0], minlength=n)
    first = np.searchsorted(got.text, np.arange(n))
    odd = []
    for k in np.flatnonzero(filled).tolist():
        if 4 * (filled[k] - known[k]) < filled[k] and not BROKEN.search(texts[k]) or texts[k].isascii():
            continue
        text = texts[k].replace("\r\n", "\n").replace("\r", "\n")
        if BROKEN.search(text) or any(not x.isascii() for j, x in enumerate(text.split("\n")) if got.language[first[k] + j] < 0):
            odd.append(k)
    tried = [(k, reading) for k in odd for reading in readings(texts[k].replace("\r\n", "\n").replace("\r", "\n"))]
    if not tried:
        return got
    owner = np.array([k for k, _ in tried])
    read = label_lines([reading for _, reading in tried], model, switch, line_switch)
    said = np.bincount(read.text[read.language >= 0], minlength=len(tried))
    for k in odd:
        mine = np.flatnonzero(owner == k)
        if len(mine):
            best = mine[said[mine].argmax()]
            if said[best] > known[k] and 2 * said[best] >= filled[k]:
                here, there = np.flatnonzero(got.text == k), np.flatnonzero(read.text == best)
                got.language[here], got.margin[here] = read.language[there], read.margin[there]
    return got


def fit(df: DataFrame, id_col: str, text_col: str, label_col: str, *, sample: int = 20_000, switch: float = 3.0, line_switch: float = 1.0) -> Model:
    """Fit on at most about ``sample`` labelled rows, chosen by a hash of the id; the only bound there is.

    Two rounds: words are counted under their row's label, then, since rows can
    be mixed or mislabelled, under the language the first model gives their line.
    """
    rows = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"), label_of(F.col(f"`{label_col}`")).alias("lang"))
    rows = rows.filter(F.col("lang").isin(*LANGUAGES) & F.col("text").isNotNull())
    n = df.select(label_of(F.col(f"`{label_col}`")).alias("lang")).filter(F.col("lang").isin(*LANGUAGES)).count()
    share = min(1.0, sample / n) if n else 1.0
    rows = rows.filter(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < int(share * (1 << 20)))
    rows = stage(rows.repartition(df.sparkSession.sparkContext.defaultParallelism), "labelled")  # bounded: spread over all cores

    def counts(model: Model | None):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: dict[tuple[str, str], int] = {}
            for batch in bounded(batches, "text"):
                texts, labels = batch.column("text").to_pylist(), batch.column("lang").to_pylist()
                if model is None:
                    parts = zip(texts, labels, strict=True)
                else:
                    got = label_lines(texts, model, switch, line_switch)
                    lines = [x for t in texts for x in t.replace("\r\n", "\n").replace("\r", "\n").split("\n")]
                    parts = ((x, LANGUAGES[k]) for x, k in zip(lines, got.language.tolist(), strict=True) if k >= 0)
                for part, lang in parts:
                    for word in set(TOKEN.findall(part.lower())):
                        key = (word, lang)
                        held[key] = held.get(key, 0) + 1
            words = list(held)
            yield pa.RecordBatch.from_arrays(
                [pa.array([w for w, _ in words], pa.string()), pa.array([x for _, x in words], pa.string()), pa.array(list(held.values()), pa.int64())],
                ["word", "lang", "n"],
            )

        return run

    model = None
    for _ in range(2):
        got = rows.mapInArrow(counts(model), "word string, lang string, n long").groupBy("word", "lang").agg(F.sum("n").alias("n"))
        model = _model(got.filter("n >= 3 and word <> '\\n'").collect())
    return model


def stretches(df: DataFrame, id_col: str, text_col: str, model: Model, *, switch: float = 3.0, line_switch: float = 1.0) -> DataFrame:
    """(id, first_line, last_line, lang, confidence): the stretches of one language of each text, in order.

    Lines count from 0; blank lines and lines without evidence go with the stretch
    around them. The confidence is that of the mean word margin over the next best language.
    Null, empty and blank texts, and texts without evidence, have no stretch.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, "_text"):
            got = label_texts(batch.column("_text").to_pylist(), model, switch, line_switch)
            some = np.flatnonzero(got.language >= 0)
            text, lang = got.text[some], got.language[some]
            cut = np.concatenate([[True], (text[1:] != text[:-1]) | (lang[1:] != lang[:-1])]) if len(some) else np.zeros(0, bool)
            start = np.flatnonzero(cut)
            end = np.append(start[1:], len(some)) - 1 if len(start) else start
            margin = np.add.reduceat(got.margin[some], start) / (end - start + 1) if len(start) else np.zeros(0)
            sure = 1 / (1 + np.exp(-np.clip(margin, -30, 30)))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("_id").take(pa.array(text[start])), pa.array(got.number[some][start].astype(np.int32)),
                    pa.array(got.number[some][end].astype(np.int32)), pa.array([LANGUAGES[k] for k in lang[start]], pa.string()), pa.array(sure),
                ],
                ["_id", "first_line", "last_line", "lang", "confidence"],
            )

    rows = df.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").cast("string").alias("_text"))
    schema = f"_id {rows.schema['_id'].dataType.simpleString()}, first_line int, last_line int, lang string, confidence double"
    return rows.mapInArrow(run, schema).withColumnRenamed("_id", id_col)


def languages(df: DataFrame, id_col: str, text_col: str, label_col: str, model: Model, *, min_share: float = 0.25, switch: float = 3.0, line_switch: float = 1.0) -> DataFrame:
    """(id, lines, label, langs, shares, confidences): the languages in at least ``min_share`` of each text's non-blank lines.

    Every row gives a row. ``label`` is the language the row's label names, null
    if missing; ``langs`` is empty for null, empty and blank texts and where no
    line has evidence for a language.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, "_text"):
            got = label_texts(batch.column("_text").to_pylist(), model, switch, line_switch)
            n, k = batch.num_rows, len(LANGUAGES)
            lines = np.bincount(got.text[got.filled], minlength=n)
            known = got.language >= 0
            each = np.bincount(got.text[known] * k + got.language[known], minlength=n * k).reshape(n, k)
            margin = np.bincount(got.text[known] * k + got.language[known], got.margin[known], minlength=n * k).reshape(n, k)
            there = (each > 0) & (each >= min_share * lines[:, None])
            row, lang = np.nonzero(there)
            order = np.lexsort((lang, -each[row, lang], row))
            row, lang = row[order], lang[order]
            offsets = pa.array(np.concatenate([[0], np.cumsum(there.sum(1))]).astype(np.int32))
            share = each[row, lang] / np.maximum(lines[row], 1)
            sure = 1 / (1 + np.exp(-np.clip(margin[row, lang] / each[row, lang], -30, 30)))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("_id"), pa.array(lines.astype(np.int32)), batch.column("label"),
                    pa.ListArray.from_arrays(offsets, pa.array([LANGUAGES[x] for x in lang], pa.string())),
                    pa.ListArray.from_arrays(offsets, pa.array(share)), pa.ListArray.from_arrays(offsets, pa.array(sure)),
                ],
                ["_id", "lines", "label", "langs", "shares", "confidences"],
            )

    rows = df.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").cast("string").alias("_text"), label_of(F.col(f"`{label_col}`")).alias("label"))
    kind = rows.schema["_id"].dataType.simpleString()
    schema = f"_id {kind}, lines int, label string, langs array<string>, shares array<double>, confidences array<double>"
    return rows.mapInArrow(run, schema).withColumnRenamed("_id", id_col)


def doubtful(found: DataFrame, id_col: str, min_lines: int) -> DataFrame:
    """(id, lang): the languages of texts with ``min_lines`` lines whose label is missing, wrong, or one of several."""
    right = F.col("label").isNotNull() & (F.size("langs") == 1) & F.array_contains("langs", F.col("label"))
    wrong = found.filter((F.col("lines") >= min_lines) & ~F.coalesce(right, F.lit(False)))
    return wrong.select(id_col, F.explode("langs").alias("lang"))
