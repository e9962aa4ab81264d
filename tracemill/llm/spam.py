r"""Keyword-stuffed and link-list pages.

Method: term recurrence gaps and positional autocorrelation over lag windows,
and lists of distinct nouns without function words.

A text becomes one sequence of *terms*: its content words, and *shapes*, which
stand for whatever has the form of a link, a hash tag, the key of a pair, or a
price (the form only says which term it is).  Function words and numbers are
no terms.  Lines of machine text (code, logs, tables, trees, lockfiles) are
left out.  Three things are measured on the sequence:

* the *recurrence gap* of a word: how far its nearest other occurrence is.
  Prose repeats a content word after dozens of words, stuffed text within a
  few.  A word also recurs if it repeats at the same displacement as its
  neighbour, at whatever lag: a keyword list said again in its order;
* the *positional autocorrelation* of shapes: in each window of lags, the share
  of the characters around a unit whose term stands again at one of these
  lags.  Links, tags, pairs and prices in prose or beside sentences agree
  with few of the characters around them, lists of them with most;
* a run of short phrases with hardly a function word is a *noun list*: stuff
  if many of its words come again in it, at whatever distance, and a long one
  also if nearly all its words are distinct.

A unit (line, list item, sentence) is stuff if most of its term characters are
recurring or regular; sentences with function words need recurrence within a
few words.  A document is stuffed if more than half of its characters are.

Thresholds are fixed and the same at every size; they were set on the labelled
documents of even id of the smallest three tables.  No document's result
depends on another one.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..ship import ship

#: Share of a document's characters that must be stuff.
MORE_THAN = 0.5
#: Content words within which a word of a phrase recurs in stuffed text.
PHRASE_GAP = 60
#: The same for words of sentences with function words.
SENTENCE_GAP = 5
#: Share of a unit's term characters that must recur or be regular.
RECURRING = 0.5
#: Share of a long unit's content words that one word alone has only in stuffed text.
REGULAR = 0.2
#: Short units, one after the other, that make a list; share of function words that it may have.
LIST_UNITS, LIST_FUNCTION = 6, 0.02
#: Share of a list's words that occur in it more than once in a keyword list; share of distinct words of a list of distinct ones, and the units that it needs.
LIST_AGAIN, LIST_DISTINCT, DISTINCT_UNITS = 0.15, 0.8, 30
#: Words that make an item where nothing parts the items.
ITEM_WORDS = 3
#: Characters that a word counts for beside the shapes, which count for their own.
WORD_WEIGHT = 6
#: Windows of lags (in terms) of the autocorrelation, and terms on either side of a unit over which it is taken.
LAG_WINDOWS, AROUND = ((1, 4), (5, 8), (9, 16), (17, 32)), 24
#: Share of the characters around a unit that agree within a window of lags.
AGREEING = 0.5

#: Function words of English, German, Spanish and French.
FUNCTION_WORDS = frozenset(
    """a an the this that these those i you he she it we they me my your his her its our their and or but nor so yet if then else when while because as of in on at by for from with without to into over under after before since until during between about than not no is are was were be been being am do does did done have has had will would shall should can could may might must there here what which who whom whose why how where all any both each few more most other some such only own same too very just up down out off again once yes please let us
    der die das den dem des ein eine einen einem einer eines und oder aber nicht kein keine ist sind war waren sein wird werden wurde hat haben hatte ich du er sie es wir ihr mich dich sich uns mit ohne für von vom zu zum zur im am auf aus bei nach seit über unter vor durch gegen um wie was wer wo wenn weil dass ob als auch noch schon nur zwar denn sobald bitte
    el la los las un una unos unas y o pero ni no es son era fue ser está están hay ha han había yo tú él ella nosotros ellos me te se nos le les lo su sus mi de del al a en con sin por para sobre entre desde hasta que como cuando porque si más menos todavía ayer igual todo
    le les des du au aux une et ou mais ne pas est sont était étaient être ont avait je tu il elle nous vous ils elles se ce cette ces son sa ses mon ma mes en dans sur sous avec sans pour par chez vers depuis que qui quoi dont où quand comme si plus moins rien encore hier""".split()
)
_URL = re.compile(r"(?:https?:)?//[^\s<>\"')\]|]+|\bwww\.[^\s<>\"')\]|]+")
_LINK_MARKUP = re.compile(r"<a\s[^>]*>.*?</a>|!?\[[^\]\n]{0,120}\]\([^)\s]*\)", re.I)
_LINK = re.compile(f"{_LINK_MARKUP.pattern}|{_URL.pattern}", re.I)
_TAG_PAIR = re.compile(r"(?<![\w:])[a-z]{2,12}:[^\s:/,|;•»]+(?=$|[\s,|;•»/])", re.I)
_HASHTAG = re.compile(r"(?<![\w&#/])#[^\W\d_][\w-]*")
_PRICE = re.compile(r"(?:[€$£★✓✔→☆✅]\s?\d[\d.,]*|\d[\d.,]*\s?[€$£])(?!\w)")
_WORD = re.compile(r"[^\W_]+(?:['’][^\W\d_]+)?")
_MACHINE_START = re.compile(
    r"(?:>\s*)?(?:\d{4}-\d\d-\d\d[T ]\d\d:|\[?\d\d:\d\d:\d\d|at [\w$.]+\(|File \"|Traceback|import |from [\w.]+ import|def |class |func |type \w+ struct|interface |export |public |private |const |let |var |return\b|if .*[:{]\s*$|for .*:\s*$|assert |await |with .*:\s*$|@@|[+-]{3} |```|\}|\{|//|#!|/\*|\|.*\|\s*$|[\w.-]+(?:,[\w.-]+){2,}$)"
)
_MARKS = re.compile(r"[=(){;├└│┌\"\[:]|\.\d|[A-Z]{4}|\.\.\.|sha\d")
_MACHINE = re.compile(
    r"[├└│┌]|==\d|\b\d+\.\d+\.\d+\b|\b(?:PASSED|FAILED|SKIPPED|DEBUG|INFO|WARN|ERROR)\b|\.\.\. (?:ok|FAIL)|\w=\w+[-.]\w|sha\d+[-:]|[\w)\]]\(.*\)|[;{]\s*$|:\d+:|\":\s"
)
_CUT = re.compile(r"\s*(?:[|•»·;]|\s/\s)\s*|(?<=[.!?…])\s+")
_COMMA = re.compile(r",\s+")
_SENTENCE_MARKS = re.compile(r"[。！？，、।؟۔]")


def _parts(line: str) -> Iterator[str]:
    """Sentences and list items; commas part items where a line has three or more and hardly a function word."""
    for part in _CUT.split(line):
        if not part:
            continue
        if part.count(", ") >= 2:
            words = _WORD.findall(part.lower())
            if sum(w in FUNCTION_WORDS for w in words) * 8 <= len(words):
                yield from (p for p in _COMMA.split(part) if p)
                continue
        yield part


#: Terms that stand for a form; words are in small letters, so none is one of these.
LINK, TAG, KEY, PRICE = "LINK", "TAG", "KEY ", "PRICE"
_SHAPES = (LINK, TAG, PRICE)


class _Unit:
    """A stretch of text: its characters, whether it is a sentence, its function words, the items of a list that it may be (0: none), and where its terms are."""

    __slots__ = ("length", "sentence", "function", "items", "first", "last")

    def __init__(self, length: int, sentence: bool, function: int, items: int, first: int, last: int):
        self.length, self.sentence, self.function, self.items, self.first, self.last = length, sentence, function, items, first, last


class _Terms:
    """The term sequence of one text, its units, and its characters in all and in machine lines."""

    def __init__(self, text: str):
        self.terms: list[str] = []
        self.weights: list[int] = []
        self.units: list[_Unit] = []
        self.total = self.machine = 0
        for line in text.split("\n"):
            line = line.strip()
            if line:
                self.total += len(line)
                self._line(line)

    def _words(self, text: str) -> tuple[int, int]:
        """Adds the content words of a text; how many words and function words it has."""
        words = _WORD.findall(text.lower())
        content = [w for w in words if w not in FUNCTION_WORDS and not w.isdigit()]
        self.terms += content
        self.weights += [WORD_WEIGHT] * len(content)
        return len(words), sum([w in FUNCTION_WORDS for w in words]) if len(words) > len(content) else 0

    def _shaped(self, line: str, spans: list[tuple[int, int, str]], most_words: int) -> bool:
        """A line of shapes with a few words between them, as one unit; False (and nothing added) where it is more than that."""
        first, words, function, at = len(self.terms), 0, 0, 0
        for lo, hi, shape in [*spans, (len(line), len(line), "")]:
            w, f = self._words(line[at:lo])
            words, function, at = words + w, function + f, hi
            if shape:
                self.terms.append(shape)
                self.weights.append(hi - lo)
        if words > most_words or function > len(spans):
            del self.terms[first:], self.weights[first:]
            return False
        items = int(not function and spans[0][2] == PRICE)
        self.units.append(_Unit(len(line), False, function, items, first, len(self.terms)))
        return True

    def _line(self, line: str) -> None:
        if "#" in line and (spans := [(m.start(), m.end(), TAG) for m in _HASHTAG.finditer(line)]) and self._shaped(line, spans, len(spans)):
            return
        if "//" in line or "www." in line or "](" in line:
            spans = [(m.start(), m.end(), LINK) for m in _LINK.finditer(line)]
            if spans and self._shaped(line, spans, 4 * len(spans)):
                return
        if line.count(":") >= 3:
            pairs = list(_TAG_PAIR.finditer(line))
            spans = [(m.start(), m.end(), KEY + m.group().partition(":")[0].lower()) for m in pairs]
            if len(pairs) >= 3 and sum(len(m.group()) for m in pairs) > 0.35 * len(line) and self._shaped(line, spans, 4 * len(spans)):
                return
        prices = bool(("$" in line or not line.isascii()) and _PRICE.search(line))
        if not prices and (_MACHINE_START.match(line) or _MARKS.search(line) and _MACHINE.search(line)):
            self.machine += len(line)
            return
        rest = len(line)
        for part in _parts(line):
            rest -= len(part)
            if prices and (spans := [(m.start(), m.end(), PRICE) for m in _PRICE.finditer(part)]) and self._shaped(part, spans, 8):
                continue
            first = len(self.terms)
            words, function = self._words(part)
            short = words <= 6 and function <= 1 and not part.endswith((".", "!", "?", ":"))
            listed = short or not function and not part.endswith((".", "!", "?", ":"))
            items = max(1, words // ITEM_WORDS) if listed and len(self.terms) > first and not _SENTENCE_MARKS.search(part) else 0
            self.units.append(_Unit(len(part), not (short or function * 6 <= words), function, items, first, len(self.terms)))
        if self.units and rest > 0:
            self.units[-1].length += rest


def _recurrence(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each term the distance to its nearest other occurrence (2**40 where there is none), and to the one before it (0 where there is none)."""
    order = np.argsort(codes, kind="stable")
    step = np.diff(order)
    same = codes[order[1:]] == codes[order[:-1]]
    back = np.zeros(len(codes), np.int64)
    gap = np.full(len(codes), 1 << 40, np.int64)
    back[order[1:][same]] = step[same]
    gap[order[1:][same]] = step[same]
    earlier = order[:-1][same]
    gap[earlier] = np.minimum(gap[earlier], step[same])
    return gap, back


def _displaced(back: np.ndarray) -> np.ndarray:
    """Terms that repeat at the displacement of a neighbour, said first or again."""
    run = np.zeros(len(back), bool)
    alike = (back[1:] == back[:-1]) & (back[1:] > 0)
    run[1:] |= alike
    run[:-1] |= alike
    again = np.flatnonzero(run)
    run[again - back[again]] = True
    return run


def stuffed_shares(texts: list[str | None], rules: Counter | None = None) -> list[float]:
    """Share of each text's characters (white space at the ends of lines aside) that is stuff; 0 for null and blank.

    ``rules`` counts the characters of stuff by what found them: ``gap``,
    ``lag`` (displacement and autocorrelation), ``list``, ``sentence``.
    """
    docs = [_Terms(t) if t else None for t in texts]
    # one sequence of all texts; a term is another one in another text, and lags never reach over
    flat, weights, starts, shape = [], [], [], []
    code: dict[str, int] = {}
    taken = 0
    for d in docs:
        starts.append(len(flat))
        if d is None or d.machine >= (1 - MORE_THAN) * d.total:  # what is left can't be more than half
            continue
        code.clear()
        flat += [code.setdefault(t, taken + len(code)) for t in d.terms]
        taken += len(code)
        weights += d.weights
        shape += [t in _SHAPES or t.startswith(KEY) for t in d.terms]
    codes, w, shaped = np.asarray(flat, np.int64), np.asarray(weights, np.float64), np.asarray(shape, bool)
    gap, back = _recurrence(codes)
    moved = _displaced(back) & ~shaped
    agree = []
    for low, high in LAG_WINDOWS:
        found = np.zeros(len(codes), bool)
        if shaped.any():
            for lag in range(low, high + 1):
                eq = (codes[lag:] == codes[:-lag]) & shaped[lag:]
                found[lag:] |= eq
                found[:-lag] |= eq
        agree.append(found)
    # running sums of characters: all terms; words near their own kind; these with the shapes that agree, by window of lags
    sums = lambda x: np.concatenate([[0.0], np.cumsum(x)])
    near = (gap <= PHRASE_GAP) & ~shaped
    all_w, near_w, moved_w, agree_w = sums(w), sums(w * near), sums(w * moved), [sums(w * (near | x)) for x in agree]
    out = []
    for d, start in zip(docs, starts, strict=True):
        if d is None or not d.total or d.machine >= (1 - MORE_THAN) * d.total:
            out.append(0.0)
            continue
        end = start + len(d.terms)
        lists = set() if d.machine else _lists(d)
        stuff = 0
        for n, u in enumerate(d.units):
            a, b = start + u.first, start + u.last
            if a == b:
                continue
            if u.sentence:
                rule = "sentence" if _repeats(d.terms, gap[a:b], u.first, u.last) else None
            else:
                rule = None
                own = all_w[b] - all_w[a]
                lo, hi = max(start, a - AROUND), min(end, b + AROUND)
                most = lambda x, a=a, b=b, own=own: x[b] - x[a] >= RECURRING * own
                if most(near_w):
                    rule = "gap"
                elif most(moved_w) or any(most(x) and x[hi] - x[lo] >= AGREEING * (all_w[hi] - all_w[lo]) for x in agree_w):
                    rule = "lag"
                elif n in lists:
                    rule = "list"
            if rule:
                stuff += u.length
                if rules is not None:
                    rules[rule] += u.length
        out.append(stuff / d.total)
    return out


def stuffed_share(text: str) -> float:
    """The share of one text."""
    return stuffed_shares([text])[0]


def _lists(d: _Terms) -> set[int]:
    """Units of noun lists: runs of short phrases with hardly a function word, whose words come again or, in a long one, are nearly all distinct."""
    out: set[int] = set()
    start = 0
    for i in range(len(d.units) + 1):
        if i < len(d.units) and d.units[i].items:
            continue
        run = d.units[start:i]
        items = sum(u.items for u in run)
        if items >= LIST_UNITS:
            words = d.terms[run[0].first : run[-1].last]
            if sum(u.function for u in run) <= LIST_FUNCTION * len(words):
                seen = Counter(words)
                again = sum(n for n in seen.values() if n > 1)
                if again >= LIST_AGAIN * len(words) or items >= DISTINCT_UNITS and len(seen) >= LIST_DISTINCT * len(words):
                    out.update(range(start, i))
        start = i + 1
    return out


def _repeats(terms: list[str], gap: np.ndarray, first: int, last: int) -> bool:
    """Whether a sentence is a frame for a phrase: most of its words recur at once, one of them three times; or one word has a fifth of a long one."""
    m = last - first
    near = int((gap <= SENTENCE_GAP).sum())
    if not near:
        return False
    if near >= RECURRING * m:
        around = Counter(terms[max(0, first - SENTENCE_GAP) : last + SENTENCE_GAP])
        if any(around[t] >= 3 for t in terms[first:last]):
            return True
    own = terms[first:last]
    return m >= 12 and len(set(own)) <= (1 - REGULAR) * m + 1 and max(Counter(own).values()) >= REGULAR * m


def spam_shares(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id of each row and ``share``, the stuffed share of its text (0 for null and blank)."""
    ship(documents.sparkSession)
    kind = documents.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            step = max(1, int(batch.num_rows * 2_000_000 / max(2_000_000, pc.sum(pc.binary_length(batch.column("text"))).as_py() or 0)))
            for a in range(0, batch.num_rows, step):
                part = batch.slice(a, step)
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(stuffed_shares(part.column("text").to_pylist()), pa.float64())], names=[id_col, "share"])

    return documents.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"`{id_col}` {kind}, share double")


def find_spam(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", more_than: float = MORE_THAN) -> DataFrame:
    """The ids of documents of which more than half is stuff; repeated rows come out once each.

    Null and blank texts are none; an empty table gives no rows.
    """
    return spam_shares(documents, id_col, text_col).where(F.col("share") > more_than).select(id_col)
