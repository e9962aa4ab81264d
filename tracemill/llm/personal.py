r"""Personal information in free text.

Method: bootstrapped contextual extraction.

1. One scan of the texts gives *mentions*: stretches that have the shape of an
   email, phone number, identity number, address or name, with the words
   around them (one or two to the left, one to the right).  Mentions of a
   strict form are *certain*; of looser forms, and all names, they are
   candidates.
2. Seeds are the certain mentions of each type and the names of the lexicon
   (incomplete, with everyday words among them).
3. Patterns and instances form a bipartite graph.  Spark scores it in rounds:
   a pattern is as good as the mean of its distinct fillers, an instance as
   good as the best pattern that it fills; so good patterns teach unseen
   words, and those teach further patterns.  The rounds end when no score
   moves by more than ``SETTLED``.  A pattern needs ``LEAST_FILLERS`` distinct
   fillers, so one repeated phrase (a service named like a person) teaches
   nothing.  An instance is, for names, each of their words; for identity
   numbers, their shape; for the other types, which have no parts that
   another one would share, the mention itself.
4. Candidates in patterns of at least ``ACCEPT`` are found, each as the type
   whose pattern scores best; certain mentions are found whatever is around
   them.  ``found_paths`` counts which rows have which of the two.

The graph has distinct (pattern, filler) pairs only, in tables; each round is
two aggregations and two joins.  Patterns and words are joined, never
collected or broadcast by hand; only the lexicon (309 rows, fixed) goes to the
workers as it is.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scratch import Scratch
from .contents import scan_contents
from .spam import FUNCTION_WORDS

#: Score from which a pattern's fillers are taken.
ACCEPT = 0.45
#: Distinct fillers that a pattern needs.
LEAST_FILLERS = 3
#: What a pattern's score counts for as the score of its fillers: less than one, so that scores settle near their seeds and don't feed on each other.
DAMPING = 0.75
#: Change of a score from which there is another round, and rounds after which the loop is taken for endless (an error).
SETTLED, MOST_ROUNDS = 0.01, 50

# -- emails ---------------------------------------------------------------------
_EMAIL = re.compile(r"(?<![\w.+%@/:-])[\w.+%-]+@(?:[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?\.)+[A-Za-z]{2,24}(?![\w@-])")
_HIDDEN_EMAIL = re.compile(r"(?i)(?<![\w.+%@/:-])[\w.+%-]+ ?(?:\[at\]|\(at\)|\{at\}|<at>) ?[a-z0-9-]+(?:(?: ?(?:\[dot\]|\(dot\)|\{dot\}|<dot>) ?|\.)[a-z0-9-]+)+(?![\w-])|(?<![\w.+%@/:-])[\w.+%-]+ at [a-z0-9-]+(?: dot [a-z0-9-]+)+\b")
#: Last labels of hosts that are no mail domains.
_HOST_ENDS = {"internal", "corp", "prod", "local", "localhost", "lan", "svc", "cluster", "intra", "home", "py", "js", "ts", "java", "go", "rb", "git", "log", "json", "yml", "yaml", "png", "jpg"}
_LOGIN_BEFORE = re.compile(r"(?:\b(?:ssh|scp|sftp|rsync|mosh|clone|remote|fetch|pull|push)\b[^\n]{0,40}|://[^\s]*)$")

# -- phone numbers --------------------------------------------------------------
_PHONE = re.compile(
    r"(?<![\w.+/#-])(?<!\d )(?:"
    r"\+\d{1,3}[ .-]?\(?\d{1,4}\)?(?:[ .-]?\d{2,5}){1,5}"  # +49 30 23125 717, +1-860-555-0128, +17355550196, +33 1 99 00 34 58
    r"|00\d{2}[ -]\d{1,4}[ -]\d{3,8}(?:[ -]?\d{2,5})?"  # 0049-30-23125436
    r"|\(\d{3}\) ?\d{3}[ .-]\d{4}"  # (754) 555-0158
    r"|\d{3}([.-])\d{3}\1\d{4}"  # 585.555.0110
    r"|0\d{3,4} \d{5,6}"  # 07700 900406
    r"|0\d(?: \d{2}){4}"  # 01 99 00 34 58
    r")(?![\w-]|\.\d)"
)
#: Words before a number that make it something else.
_NO_PHONE = re.compile(r"(?i)\b(?:order|invoice|build|version|release|ticket|case|flight|code|epoch|offset|serial|sku|item|part|batch|job|run|commit|revision|port|id|ref|rows|tracking|parcel|at|v)[ #:.-]*(?:no\.?|number|nr\.?)?[ #:.-]*$")

# -- identity numbers -----------------------------------------------------------
_STRICT_ID = re.compile(
    r"(?<![\w-])(?:\d{3}-\d{2}-\d{4}|\d{3} \d{2} \d{4}"  # social security number
    r"|\d{4}-\d{6}-\d"  # national id
    r"|[A-Z]{2} ?\d{2} ?\d{2} ?\d{2} ?[A-D]"  # national insurance number
    r"|\d{8}-[A-Z]"  # DNI
    r"|[A-Z]\d{4}-\d{5}-\d{5}"  # driver licence
    r")(?![\w-])"
)
_LOOSE_ID = re.compile(r"(?<![\w./:+-])(?=(?:[A-Z0-9-]*\d){2})(?=[A-Z0-9-]*[A-Z]|\d{7,12}(?!\d))[A-Z0-9](?:[A-Z0-9]|-(?=[A-Z0-9])){6,16}(?![\w./:+-]|-)(?<!\.)")
_NO_ID = re.compile(r"(?i)\b(?:order|invoice|build|case|booking|reservation|voucher|locator|flight|product|build|ticket|seat|row|epoch|offset)[ #:.-]*(?:code|no\.?|number)?[ #:.-]*$")

# -- addresses ------------------------------------------------------------------
_CAP = r"[A-ZÀ-ÖØ-Þ][\w'’]*(?:-[A-ZÀ-ÖØ-Þ]?[\w'’]+)*"
_TOWN = rf"(?:(?:Port|San|Santa|Santo|New|Saint|St\.?|Sankt|Bad|Los|Las|El|La|Le|Les|Upper|Lower|North|South|East|West|Great|Little|Old|Fort|Mount|Lake|Cape|Villa|Castle) )?{_CAP}"
_STREET_END = r"(?:Street|St|Road|Rd|Lane|Ln|Avenue|Ave|Court|Ct|Boulevard|Blvd|Terrace|Ter|Close|Drive|Dr|Way|Place|Pl|Square|Sq|Crescent|Cres|Row|Walk|Gardens|Grove|Hill|Mews|Parade|Parkway|Pkwy|Circle|Cir|Highway|Hwy|Alley|Quay|Rise|View|Wharf)\.?"
_UNIT = r"(?:Apt|Apartment|Unit|Suite|Ste|Flat|Floor|Fl|Room|Rm|#)\.? ?[A-Z]?\d*[A-Z]?"
_POST = r"(?:\d{4,5}(?:-\d{4})?|[A-Z]{1,2}\d[A-Z\d]? ?\d[A-Z]{2})"
_ADDRESS = re.compile(
    r"(?<![\w.#/-])(?:"
    # [unit, ]number name street-word[, unit], town[ postcode]
    rf"(?:{_UNIT},? )?\d{{1,5}}[A-Za-z]? (?:{_CAP} ){{1,4}}{_STREET_END}(?:,? {_UNIT})?, {_TOWN}(?: {_POST}|, [A-Z]{{2}} {_POST})?"
    # number, street-word of name, postcode town
    rf"|\d{{1,4}}(?: ?(?:bis|ter))?,? (?:rue|avenue|boulevard|place|chemin|allée|impasse|quai|route|cours|square|Rue|Avenue|Boulevard|Place|Chemin|Allée|Impasse|Quai|Route) (?:(?:de|des|du|d'|la|le|les|l'|de la|de l')[ ']?)*{_CAP}(?: {_CAP}){{0,3}}, {_POST} {_TOWN}"
    # street-word of name number[, floor], postcode town
    rf"|(?:Calle|Avenida|Avda\.?|Plaza|Paseo|Camino|Ronda|Carretera|Travesía|C/) ?(?:(?:de|del|la|las|los|el) )*{_CAP}(?: {_CAP}){{0,3}},? \d{{1,4}}(?:, ?\d{{1,2}}\.?[ºª°o]? ?(?:[A-Z]|izq\.?|dcha\.?)?)?, {_POST} {_TOWN}"
    # name-street number, or preposition name number, postcode town
    rf"|(?:(?:Am|An der|An den|Auf dem|Auf der|Im|In der|In den|Zum|Zur|Unter den|Hinter der|Alte[rn]?|Neue[rn]?) {_CAP}|{_CAP}[ -](?:Straße|Allee|Gasse|Weg|Platz|Ufer|Damm|Ring|Hof|Markt|Chaussee)|[A-ZÀ-ÖØ-Þ][\w'’-]*?(?:straße|strasse|gasse|allee|weg|platz|ufer|damm|ring|hof|steig|stieg|markt|graben|chaussee|str\.)) \d{{1,4}} ?[a-z]?, {_POST} {_TOWN}"
    # box number, town and postcode
    rf"|(?:P\.? ?O\.? ?Box|Postfach|Apartado(?: de Correos)?|BP|Boîte postale) \d{{1,6}}, (?:{_POST} {_TOWN}|{_TOWN}(?: {_POST})?)"
    r")(?![\w-])",
    re.UNICODE,
)

# -- looser forms: candidates of emails, phone numbers and addresses -----------------
_LOOSE_EMAIL = re.compile(r"(?i)(?<![\w.+%@/:-])[\w.+%-]*\w(?:@| @ | at | ?[\[({<](?:at|@)[\])}>] ?)[a-z0-9-]+(?:(?:\.| \. | dot | ?[\[({<](?:dot|\.)[\])}>] ?)[a-z0-9-]+)+(?![\w@-])")
_LOOSE_PHONE = re.compile(r"(?<![\w.+/#:=-])(?!\d{4}-\d\d-\d\d|\d\d?[./-]\d\d?[./-]\d{4}|\d{1,3}(?:\.\d{1,3}){3})\(?\+?\d[\d() ./-]{5,18}\d(?![\w/:-]|\.\d)")
#: A quoted value of a field, with a digit, a capital and a comma.
_LOOSE_ADDRESS = re.compile(r"(?<=[:=] \")(?=[^\"\n]*\d)(?=[^\"\n]*[A-ZÀ-Þ][a-zà-ÿ])[^\"\n,{}\[\]]{3,60},[^\"\n{}\[\]]{3,80}(?=\")|(?<=[:=]\")(?=[^\"\n]*\d)(?=[^\"\n]*[A-ZÀ-Þ][a-zà-ÿ])[^\"\n,{}\[\]]{3,60},[^\"\n{}\[\]]{3,80}(?=\")")

# -- names ----------------------------------------------------------------------
#: Particles of family names.
_PARTICLES = "de la|de los|van der|van den|von der|von und zu|van|von|der|den|de|del|della|di|da|dos|du|le|la|ter|ten|bin|ibn|al|zu|zur|af|y"
_T = r"[A-ZÀ-ÖØ-ÞŠŽ][\w'’]+(?:-[A-ZÀ-ÖØ-ÞŠŽ][\w'’]+)*"
_NAME = re.compile(rf"(?<![\w@./\\-])(?:(?:{_PARTICLES}) )?(?:{_T}|[A-Z]\.)(?:,? (?:(?:{_PARTICLES}) )?(?:{_T}|[A-Z]\.(?!\w)))*(?![\w@/\\]|\.\w|-\w)")
_LOWER = r"[a-zà-öø-ÿšž][\w'’]+(?:-[\w'’]+)*"
_AFTER_LOWER = re.compile(rf"(?:-{_LOWER})?(?P<c>,)? (?:(?:{_PARTICLES}|[a-z]\.) )?(?P<n>{_LOWER})")
_LOWER_PAIR = re.compile(rf"(?<![\w@.+/-])(?=({_LOWER}) (?:(?:{_PARTICLES}|[a-z]\.) )?({_LOWER})(?![\w@/.]|-\w))")
_BEFORE_LOWER = re.compile(rf"({_LOWER}|(?<!\w)[a-z]\.) (?:(?:{_PARTICLES}|[a-z]\.) )?$")
#: Words before a name that are titles or labels, and words that begin sentences.
_LEADING = set(
    "passenger dr mr mrs ms miss prof herr frau señor señora sr sra monsieur madame mme customer client contact author user guest dear hello hi hey hallo hola bonjour cher the this that these those a an from to cc for by with and or but if it its we you i my our your he she they please could would nothing both only there since let not when once after before on in at as is was will does why what who how where note ticket order name kind best regards thanks signed reviewed tested".split()
)
_FOLLOWING = set("the this that a an for again and or on owns asked wrote said is was has will y wegen for erreichbar please could would nothing both only there since let my our we you it if with why".split())
_WORD = re.compile(r"[^\W\d_][\w'’]*")
_CONTEXT = re.compile(r"\w+|[^\w\s]|\n")


def _context(text: str, lo: int, hi: int, certain: list[tuple[str, int, int]]) -> tuple[str, str, str]:
    """The words left (last one, last two, with the marks after them) and right of a stretch.

    Digits are 0; a certain mention (kind, start, end) to the left is one word, its kind.
    """
    near = max((x for x in certain if lo - 48 < x[2] <= lo), key=lambda x: x[2], default=None)
    if near:
        left = text[max(0, near[1] - 32) : near[1]] + f" _{near[0]} " + text[near[2] : lo]
    else:
        left = text[max(0, lo - 48) : lo]
    before = _CONTEXT.findall(left.replace("\r", ""))
    if lo <= 48 and (not before or before[0] != "\n"):
        before.insert(0, "\n")
    one: list[str] = []
    two: list[str] = []
    words = 0
    for t in reversed(before):
        if t.isalnum() or "_" in t:
            words += 1
        elif words and t in "\n.!?;{}":
            two.append("^")
            if words == 1:
                one.append("^")
            break
        if words <= 1 and len(one) < 6:
            one.append(t)
        if words <= 2 and len(two) < 9:
            two.append(t)
        if words == 2:
            break
    after = _CONTEXT.search(text, hi, hi + 30)
    right = after.group() if after else "\n"
    norm = lambda x: re.sub(r"\d+", "0", " ".join(x).lower().replace("\n", "⏎"))
    return norm(reversed(one)), norm(reversed(two)), norm([right])


class MentionFinder:
    """Mentions of a text: kind, stretch, and the words around candidates."""

    def __init__(self, lexicon: list[str]):
        import ahocorasick

        self.known = {n.lower() for n in lexicon if n}
        self.names = ahocorasick.Automaton()
        for n in self.known:
            self.names.add_word(n, n)
        if self.known:
            self.names.make_automaton()

    def emails(self, text: str) -> list[tuple[int, int]]:
        out = []
        low = text.lower()
        if "@" in text:
            for m in _EMAIL.finditer(text):
                last = m.group().rpartition(".")[2].lower()
                if last in _HOST_ENDS or _LOGIN_BEFORE.search(text, max(0, m.start() - 60), m.start()):
                    continue
                if text[m.end() : m.end() + 1] == ":" and re.match(r":[\w~./-]+/", text[m.end() : m.end() + 80]):
                    continue
                out.append(m.span())
        if "at]" in low or "at)" in low or "at}" in low or "at>" in low or " dot " in low:
            out += [m.span() for m in _HIDDEN_EMAIL.finditer(text)]
        return out

    def phones(self, text: str) -> list[tuple[int, int]]:
        out = []
        for m in _PHONE.finditer(text):
            digits = sum(c.isdigit() for c in m.group())
            if 9 <= digits <= 15 and not _NO_PHONE.search(text, max(0, m.start() - 24), m.start()):
                out.append(m.span())
        return out

    def title_names(self, text: str) -> list[tuple[int, int]]:
        out = []
        for m in _NAME.finditer(text):
            lo, hi = m.span()
            words = [(w.group(), lo + w.start(), lo + w.end()) for w in re.finditer(r"[^\s,]+", m.group())]
            while words and words[0][0].rstrip(".").lower() in _LEADING and not (len(words[0][0]) == 2 and words[0][0][1] == "."):
                words.pop(0)
            if not words:
                continue
            for i, (w, _, _) in enumerate(words[1:], 1):  # a sentence that begins after the name
                if w.lower() in _FOLLOWING | _LEADING and w[0].isupper() and not w.isupper():
                    words = words[:i]
                    break
            commas = [i for i, (_, _, e) in enumerate(words[:-1]) if text[e : e + 1] == ","]
            if commas:  # an inverted name has nothing but its family before the comma
                i = commas[0]
                if len(commas) > 1:
                    words = words[: commas[1] + 1]
                if sum(w[0].isupper() for w, _, _ in words[: i + 1]) > 1 or len(words) - i > 3 or words[i][0].endswith("."):
                    words = words[: i + 1]
                    commas = []
            lo, hi = words[0][1], words[-1][2]
            solid = [w for w, _, _ in words if len(w.rstrip(".")) > 1 and w[0].isupper()]
            if not solid:
                continue
            if words[-1][0].endswith(".") and len(words[-1][0]) == 2 and not commas:
                continue
            quoted = text[lo - 1 : lo] in "\"'" and text[hi : hi + 1] == text[lo - 1 : lo] and lo > 0
            if len(words) == 1 and not quoted:
                continue
            out.append((lo, hi))
        return out

    def lower_names(self, low: str, text: str) -> list[tuple[int, int]]:
        """Names in small letters: one word of the lexicon and the word that goes with it."""
        out: list[tuple[int, int]] = []
        if not self.known:
            return out
        for end, n in self.names.iter(low):
            lo, hi = end - len(n) + 1, end + 1
            if not text[lo].islower() or (lo and (text[lo - 1].isalnum() or text[lo - 1] in "_@./\\-+")) or (hi < len(text) and (text[hi].isalnum() or text[hi] in "_@/\\+")):
                continue
            if out and lo < out[-1][1]:
                continue
            m = _AFTER_LOWER.match(text, hi)
            nxt = m.group("n") if m else None
            if nxt and (m.group("c") is None or nxt in self.known) and nxt not in _FOLLOWING and nxt.lower() not in _LEADING and not text[m.end() : m.end() + 1].isalnum():
                out.append((lo, m.end()))
                continue
            b = _BEFORE_LOWER.search(text[max(0, lo - 40) : lo])
            if b and b.group(1) not in _LEADING:
                out.append((max(0, lo - 40) + b.start(), hi))
        return out

    def find(self, text: str) -> list[tuple[str, int, int, bool]]:
        """(kind, start, end, certain), by start; an earlier kind of the list wins where two overlap."""
        taken: list[tuple[int, int]] = []
        out: list[tuple[str, int, int, bool]] = []

        def take(kind: str, spans: list[tuple[int, int]], certain: bool) -> None:
            for lo, hi in spans:
                if all(hi <= a or lo >= b for a, b in taken):
                    taken.append((lo, hi))
                    out.append((kind, lo, hi, certain))

        take("email", self.emails(text), True)
        take("address", [m.span() for m in _ADDRESS.finditer(text)], True)
        strict = [m.span() for m in _STRICT_ID.finditer(text) if not _NO_ID.search(text, max(0, m.start() - 24), m.start())]
        take("id_number", strict, True)
        take("phone", self.phones(text), True)
        loose = [m.span() for m in _LOOSE_ID.finditer(text) if not _NO_ID.search(text, max(0, m.start() - 24), m.start())]
        if "@" in text or " at" in text or "[at" in text or "(at" in text:
            take("email", [m.span() for m in _LOOSE_EMAIL.finditer(text)], False)
        if '"' in text:
            take("address", [m.span() for m in _LOOSE_ADDRESS.finditer(text)], False)
        fixed = list(taken)
        take("id_number", loose, False)
        for m in _LOOSE_PHONE.finditer(text):  # digits alone may be of either type: their patterns decide
            lo, hi = m.span()
            if 7 <= sum(map(str.isdigit, m.group())) <= 15 and all(hi <= a or lo >= b for a, b in fixed) and not _NO_PHONE.search(text, max(0, lo - 24), lo):
                out.append(("phone", lo, hi, False))
        take("name", self.title_names(text), False)
        take("name", self.lower_names(text.lower(), text), False)
        fixed = list(taken)
        for lo, hi in self.lower_near([(a, b) for kind, a, b, sure in out if sure], text):
            if all(hi <= a or lo >= b for a, b in fixed):
                out.append(("name", lo, hi, False))
        return out

    @staticmethod
    def lower_near(certain: list[tuple[int, int]], text: str) -> list[tuple[int, int]]:
        """Pairs of words in small letters beside a certain mention, any of which may be a name that no lexicon has.

        They overlap; only the one that fills a good pattern is found.
        """
        out: dict[tuple[int, int], None] = {}
        for lo, hi in certain:
            for a, b in ((max(0, lo - 60), lo), (hi, hi + 40)):
                for m in _LOWER_PAIR.finditer(text, a, min(b, len(text))):
                    first, last = m.group(1), m.group(2)
                    if first not in FUNCTION_WORDS and last not in FUNCTION_WORDS and first not in _LEADING and last not in _FOLLOWING:
                        out[m.start(1), m.end(2)] = None
        return list(out)


def _mentions(lexicon: list[str]) -> Callable[[], Callable[[str], list[tuple]]]:
    def make() -> Callable[[str], list[tuple]]:
        finder = MentionFinder(lexicon)

        def look(text: str) -> list[tuple]:
            rows = []
            found = finder.find(text)
            sure = [(kind, lo, hi) for kind, lo, hi, certain in found if certain]
            for kind, lo, hi, certain in found:
                one, two, right = _context(text, lo, hi, [x for x in sure if x[1] < lo])
                rows.append((kind, text[lo:hi], lo, int(certain), one, two, right))
            return rows

        return look

    return make


_FIELDS = [("kind", "string"), ("text", "string"), ("start", "int"), ("certain", "int"), ("one", "string"), ("two", "string"), ("right", "string")]


def mentions(attack_view: DataFrame, name_lexicon: DataFrame) -> DataFrame:
    """All mentions of all messages, with their contexts.  The lexicon is a fixed small table."""
    names = [r["name"] for r in name_lexicon.select("name").where("name is not null").distinct().collect()]
    return scan_contents(attack_view, _mentions(names), _FIELDS)


def _patterns() -> Column:
    return F.array(F.concat_ws("\t", F.lit("1"), "one", "right"), F.concat_ws("\t", F.lit("2"), "two", "right"))


def pattern_scores(found: DataFrame, name_lexicon: DataFrame, scratch: Scratch) -> DataFrame:
    """``kind``, ``pattern``, ``score``, ``fillers`` of all patterns, once the scores have settled."""
    each = found.select("kind", "text", "certain", "one", "two", "right").distinct()
    pairs = scratch.save(each.select("kind", F.lower("text").alias("filler"), "certain", F.explode(_patterns()).alias("pattern")).groupBy("kind", "filler", "pattern").agg(F.max("certain").alias("certain")), "pairs")
    # the instances of a filler: of names the words without initials and particles, of identity numbers the shape, else the filler
    small = F.split(F.regexp_replace(F.regexp_replace("filler", r"\b\p{L}\.", " "), rf"(?<!\p{{L}})(?:{_PARTICLES})(?!\p{{L}})", " "), r"[^\p{L}'’]+")
    mixed = F.col("filler").rlike(r"^[a-z0-9]+$") & F.col("filler").rlike(r"[a-z]") & ~F.col("filler").rlike(r"^[a-z]\d+$")
    shape = F.when(mixed, F.concat(F.lit("mixed"), F.length("filler"))).otherwise(F.regexp_replace(F.regexp_replace("filler", r"\d", "0"), r"\p{L}", "a"))
    parts = F.when(F.col("kind") == "name", F.filter(small, lambda w: F.length(w) > 1)).when(F.col("kind") == "id_number", F.array(shape)).otherwise(F.array("filler"))
    words = pairs.groupBy("kind", "filler").agg(F.max("certain").alias("certain")).select("kind", "filler", "certain", F.explode(F.array_distinct(parts)).alias("word"))
    known_names = name_lexicon.select(F.lower("name").alias("word")).where("word is not null").distinct().select(F.lit("name").alias("kind"), "word", F.lit(1.0).alias("seed"))
    seed = F.when((F.col("kind") != "name") & (F.col("certain") == 1), 1.0).otherwise(F.coalesce("seed", F.lit(0.0)))
    base = scratch.save(words.join(known_names, ["kind", "word"], "left").select("kind", "filler", "word", seed.alias("seed")), "seeded")
    scores, k = None, 0
    while True:
        if scores is None:
            known = base.withColumn("score", F.col("seed"))
        else:
            taught = pairs.join(scores.select("kind", "pattern", "score"), ["kind", "pattern"]).groupBy("kind", "filler").agg(F.max("score").alias("score"))
            best = base.select("kind", "filler", "word").join(taught, ["kind", "filler"]).groupBy("kind", "word").agg((DAMPING * F.max("score")).alias("score"))
            known = base.join(best, ["kind", "word"], "left").select("kind", "filler", "word", F.greatest("seed", F.coalesce("score", F.lit(0.0))).alias("score"))
        fillers = known.groupBy("kind", "filler").agg(F.avg("score").alias("f"))
        scored = pairs.select("kind", "pattern", "filler").join(fillers, ["kind", "filler"]).groupBy("kind", "pattern").agg((F.sum("f") / (F.count("*") + 1)).alias("score"), F.count("*").alias("fillers")).where(F.col("fillers") >= LEAST_FILLERS)
        if scores is not None:
            scored = scored.join(scores.select("kind", "pattern", F.col("score").alias("before")), ["kind", "pattern"]).withColumn("moved", F.abs(F.col("score") - F.col("before"))).drop("before")
        else:
            scored = scored.withColumn("moved", F.lit(1.0))
        last, scores = scores, scratch.save(scored, f"scores{k}")
        if not scores.where(F.col("moved") > SETTLED).head(1):
            return scores.drop("moved")
        if last is not None:
            scratch.drop(f"scores{k - 1}")
        k += 1
        if k >= MOST_ROUNDS:
            raise RuntimeError(f"pattern scores did not settle in {MOST_ROUNDS} rounds")


def find_personal(attack_view: DataFrame, name_lexicon: DataFrame) -> DataFrame:
    """``request_id``, ``message_index``, ``pii_type``, ``pii_text``, ``start``, ``form`` and ``context``: every mention found, and by what.

    ``form``: 1 if certain by its form; ``context``: the score of its best
    learnt pattern (0 where none is accepted).  Null ids, messages and contents
    give nothing; an empty table gives no rows, an empty lexicon no names.
    """
    scratch = Scratch(attack_view.sparkSession, "personal")
    found = scratch.save(mentions(attack_view, name_lexicon), "mentions")
    good = pattern_scores(found, name_lexicon, scratch).where(F.col("score") >= ACCEPT).select("kind", "pattern", "score")
    # the score belongs to the distinct contexts, of which there are far fewer than mentions
    contexts = scratch.save(found.select("kind", "one", "two", "right").distinct().withColumn("pattern", F.explode(_patterns())).join(good, ["kind", "pattern"]).groupBy("kind", "one", "two", "right").agg(F.max("score").alias("context")), "contexts")
    keys = ["kind", "one", "two", "right"]
    scored = found.join(contexts, keys, "left").where((F.col("certain") == 1) | F.col("context").isNotNull())
    place = ["request_id", "message_index", "start", "text"]
    best = F.max_by(F.col("kind"), F.struct("certain", F.coalesce("context", F.lit(0.0)), "kind"))
    one = scored.groupBy(*place).agg(best.alias("pii_type"), F.max("certain").alias("form"), F.max(F.coalesce("context", F.lit(0.0))).alias("context"))
    return one.select("request_id", "message_index", "pii_type", F.col("text").alias("pii_text"), "start", "form", "context")


def found_paths(attack_view: DataFrame, name_lexicon: DataFrame) -> DataFrame:
    """How many mentions of each type were found by form alone, by a learnt pattern alone, or by both."""
    path = F.when(F.col("form") == 0, "context").when(F.col("context") > 0, "both").otherwise("form")
    return find_personal(attack_view, name_lexicon).groupBy("pii_type", path.alias("path")).agg(F.count("*").alias("n_mentions"))


def personal_mentions(attack_view: DataFrame, name_lexicon: DataFrame) -> DataFrame:
    """The distinct ``request_id``, ``message_index``, ``pii_type``, ``pii_text``."""
    return find_personal(attack_view, name_lexicon).select("request_id", "message_index", "pii_type", "pii_text").distinct()


def redact_personal(attack_view: DataFrame, name_lexicon: DataFrame) -> DataFrame:
    """The messages with mentions, each mention replaced by its type in brackets.

    ``request_id``, ``message_index``, ``content``, ``n_mentions``; distinct.
    The rest of the text stays as it is.
    """
    scratch = Scratch(attack_view.sparkSession, "redacted")
    span = F.struct(F.col("start"), F.char_length("pii_text").alias("length"), F.concat(F.lit("["), F.upper("pii_type"), F.lit("]")).alias("mark"))
    spans = find_personal(attack_view, name_lexicon).groupBy("request_id", "message_index").agg(F.reverse(F.array_sort(F.collect_set(span))).alias("spans"))
    each = attack_view.where(F.col("request_id").isNotNull()).select(F.col("request_id").cast("string"), F.posexplode(F.transform("messages", lambda m: m["content"])).alias("message_index", "content")).where(F.col("content").isNotNull())
    each = each.withColumns({"a": F.xxhash64("content"), "b": F.xxhash64(F.lit(7), F.col("content"))})
    # a text has the same mentions wherever it stands, so each distinct one moves and is changed once
    places = scratch.save(each.select("request_id", "message_index", "a", "b").distinct().join(spans, ["request_id", "message_index"]), "places")
    marked = places.groupBy("a", "b").agg(F.first("spans").alias("spans"))
    both = each.groupBy("a", "b").agg(F.first("content").alias("content")).join(marked, ["a", "b"])
    # from the last span to the first; a span that reaches into the one after it is passed over
    step = "struct(concat(substring(a.text, 1, s.start), s.mark, substring(a.text, s.start + s.length + 1)) AS text, s.start AS at)"
    content = F.expr(f"aggregate(spans, struct(content AS text, cast(2147483647 AS int) AS at), (a, s) -> if(s.start + s.length <= a.at, {step}, a)).text")
    changed = both.select("a", "b", content.alias("content"), F.size("spans").alias("n_mentions"))
    return places.select("request_id", "message_index", "a", "b").join(changed, ["a", "b"]).select("request_id", "message_index", "content", "n_mentions")
