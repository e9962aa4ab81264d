r"""Credentials embedded in text.

Method: a keyword automaton says which rules can apply to a text; issuer
formats and assignment rules (regular expressions) give candidates; checksums
and checks of structure decide which are live literals; matches are replaced
by placeholders of the same length and alphabet.

Checks: tokens that carry a checksum (CRC-32 in base 62 at the end) count
whatever they look like if it holds, and as others do if not, as issuers with
the same form need not have one; signed tokens are decoded, and a header that
is readable must be JSON; private keys must have a body in base 64, closed by
the END mark or cut off; access-key ids must be of the issuer's alphabet.

Rules come in two kinds.  *Issuer formats* are found anywhere (access-key ids,
prefixed tokens, signed tokens, private-key blocks).  *Places* are where a
secret stands by convention: assignments to a name that says so, headers,
URLs, command options, configuration files, and sentences that hand a secret
over.  A place's value counts unless it is a placeholder, a masked value, a
reference to a variable, a vault or a function, or a word.
"""

from __future__ import annotations

import base64
import json
import re
import zlib
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .contents import scan_contents
from .spam import FUNCTION_WORDS

#: Names that say that a value is secret (any case, with - or _ or a case change between the parts).
SECRET_NAME = r"(?:pass(?:w(?:or)?d|phrase|wort|code)?(?!port|enger|age|ed|ing|es|ive)|pwd|psw|pw|secret|token|credentials?|creds?|auth|api[_-]?key|access[_-]?key(?:[_-]?id)?|secret[_-]?key|private[_-]?key|sign(?:ing|ature)?[_-]?key|sig[_-]?key|encryption[_-]?key|master[_-]?key|account[_-]?key|shared[_-]?key|storage[_-]?key|bearer|kennwort|passwort|contrase(?:ñ|n)a|clave)"
#: Name parts that make such a name one of something else.
_OTHER_NAME = re.compile(r"(?i)(?:min|max|len(?:gth)?|count|policy|rules?|hash|file|path|name|type|field|label|hint|ttl|expir\w*|url|uri|id|size|limit|cache|public|regex|pattern|prompt|reset|required|used|header|prefix|format|version|digest|status)$")

#: Formats of issuers, with the least length that makes them whole.
ISSUER_FORMATS = [
    r"(?<![A-Za-z0-9])(?:AKIA|ASIA|ABIA|ACCA|AIDA|AROA)[A-Z0-9]{16}(?![A-Za-z0-9])",
    r"(?<![A-Za-z0-9])gh[pousr]_[A-Za-z0-9]{36,}",
    r"(?<![A-Za-z0-9])github_pat_[A-Za-z0-9_]{30,}",
    r"(?<![A-Za-z0-9])glpat-[A-Za-z0-9_-]{20,}",
    r"(?<![A-Za-z0-9])xox[abeoprs]-[A-Za-z0-9-]{18,}",
    r"(?<![A-Za-z0-9_-])sk-(?:[a-z]{2,8}-)?[A-Za-z0-9_-]{20,}",
    r"(?<![A-Za-z0-9])[prs]k_(?:live|prod)_[A-Za-z0-9]{12,}",
    r"(?<![A-Za-z0-9])hf_[A-Za-z0-9]{30,}",
    r"(?<![A-Za-z0-9])npm_[A-Za-z0-9]{36}(?![A-Za-z0-9])",
    r"(?<![A-Za-z0-9])AIza[A-Za-z0-9_-]{35}(?![A-Za-z0-9_-])",
    r"(?<![A-Za-z0-9])ya29\.[A-Za-z0-9_-]{20,}",
    r"(?<![A-Za-z0-9])SG\.[A-Za-z0-9_-]{16,}\.[A-Za-z0-9_-]{16,}",
    r"(?<![A-Za-z0-9])eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}",
]
_ISSUERS = re.compile("|".join(ISSUER_FORMATS))
#: Tokens of an issuer that isn't known: a short prefix, then letters of both cases (and digits) in disorder.
_UNKNOWN = re.compile(r"(?<![\w./@:+-])[a-z]{2,5}[_.](?=[A-Za-z0-9-]*[a-z])(?=[A-Za-z0-9-]*[A-Z])[A-Za-z0-9_-]{18,}(?![\w(/.-])")
_TURN = re.compile(r"[a-z](?=[A-Z0-9])|[A-Z](?=[a-z0-9])|[0-9](?=[A-Za-z])")
#: A private key that was cut off: lines in base 64 after its BEGIN mark.
_OPEN_PRIVATE = re.compile(r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----(?:(?:\\r)?\\n|\r?\n)[A-Za-z0-9+/=]{40,}(?:(?:(?:\\r)?\\n|\r?\n)[A-Za-z0-9+/=]{16,})*")
_PRIVATE = re.compile(r"-----BEGIN (?P<kind>(?:[A-Z0-9]+ )*)PRIVATE KEY(?P<tail>(?: BLOCK)?)-----.*?-----END (?P=kind)PRIVATE KEY(?P=tail)-----", re.S)

_QUOTED = r"(?P<q>\\?[\"'`])(?P<v>(?:(?!(?P=q))[^\r\n]){4,}?)(?P=q)"
_BARE = r"(?P<v>[^\s\"'`<>,;]{4,})"
_NAME = rf"(?P<n>(?:[A-Za-z0-9]+[_.-])*[A-Za-z0-9]*?{SECRET_NAME}[A-Za-z]*(?:[_-][A-Za-z]+)*)"


def _rule(keys: str, pattern: str, shape: str = "any") -> tuple[tuple[str, ...], re.Pattern, str]:
    return tuple(keys.split()), re.compile(pattern), shape


#: Keywords of the automaton that call for the assignment rules.
_NAME_KEYS = "pass pwd psw pw secret token cred auth key bearer kennwort contrase clave"

#: Keywords that call for tokens of unknown issuers: what is said of such tokens.
_UNKNOWN_KEYS = "token key secret auth bearer cred registry curl login http"

#: What follows the name in an assignment (group v is the literal), and the check of the value.
ASSIGNMENTS = [
    # name = "value", name: 'value', "name": "value", name => "value"
    (re.compile(rf"\\?[\"']?\s{{0,3}}(?::=|=>|=|:)\s{{0,3}}(?:[bfru]{{0,2}}){_QUOTED}"), "any"),
    # NAME=value, name: value, //host/:_authToken=value
    (re.compile(rf"(?:=|:[ \t]{{1,3}}|[ \t]{{1,2}}=[ \t]{{1,2}}){_BARE}"), "strong"),
    # typed declarations: const fooToken: string = "value"
    (re.compile(rf"\s{{0,2}}:\s{{0,2}}[A-Za-z]+\s{{0,2}}=\s{{0,2}}{_QUOTED}"), "any"),
]
_RUN = re.compile(r"[A-Za-z0-9_.-]*[A-Za-zñÑ0-9]")
_SECRET_NAME = re.compile(rf"(?i){_NAME}")

#: Keywords, pattern (group v is the literal), and the check of the value: "any" for places that leave no doubt, "strong" where a plain word may stand, "random" where most values are names.
PLACES = [
    # a constant that is named a key: only values that look drawn at random
    _rule("key", rf"\b(?:const|let|var|val|final|static|String)\s+\w*(?:[a-z0-9]Key|_KEY|\bkey)\s*(?::\s*\w+\s*)?=\s*{_QUOTED}", "random"),
    # Password=value; of connection strings
    _rule("password= pwd= accountkey= sharedaccesskey=", r"(?i)(?:^|[;\s\"'])(?:password|pwd|accountkey|sharedaccesskey)=(?P<v>[^;\s\"']{4,})"),
    # scheme://user:password@host
    _rule("://", r"[A-Za-z][A-Za-z0-9+.-]*://[^\s:/@\"'<>]*:(?P<v>[^\s/@\"'<>]{3,})@"),
    # Authorization headers and bare Bearer tokens
    _rule("bearer", r"(?i)\bbearer\s+(?P<v>[A-Za-z0-9+/=_~.-]{8,})", "strong"),
    _rule("basic", r"(?i)\bauthorization\\?[\"']?\s*[:=]\s*\\?[\"']?basic\s+(?P<v>[A-Za-z0-9+/=_-]{8,})"),
    # header: value of keys and tokens
    _rule("x- private-token", r"(?i)\b(?:x-[a-z-]*(?:key|token|secret|auth)|private-token)\\?[\"']?\s*:\s*\\?[\"']?(?P<v>[^\s\"'\\]{6,})", "strong"),
    # command options
    _rule("-u", r"(?:^|\s)(?:-u|--user)[ =]?[\"']?[A-Za-z0-9._@-]+:(?P<v>[^\s\"']{4,})"),
    _rule("sshpass", r"\bsshpass\s+-p\s*(?:(?P<q>[\"'])(?P<v>[^\r\n]+?)(?P=q)|(?P<w>[^\s\"']+))"),
    _rule("mysql mariadb mysqldump", r"\b(?:mysql|mysqldump|mysqladmin|mariadb)\b[^\r\n|;]*?\s-p(?P<v>[^\s\"']{4,})"),
    _rule("--", r"(?i)\s--(?:api-key|apikey|access-key|secret-key|secret|token|auth|auth-token|password|passwd|pass|passphrase|client-secret)(?:=|\s+)[\"']?(?P<v>[^\s\"']{6,})", "strong"),
    # .netrc
    _rule("machine", r"\bmachine\s+\S+\s+login\s+\S+\s+password\s+(?P<v>\S+)"),
    # keys handed out in query strings
    _rule("key= token= sig=", r"(?i)[?&](?:[a-z_-]*(?:key|token|sig|secret))=(?P<v>[A-Za-z0-9+/_~.=-]{12,})", "strong"),
    # sentences that hand a secret over
    _rule("password passcode passphrase pin", r"(?i)\bthe (?:[a-z]+ )?pass(?:word|code|phrase) (?:for|of|to) [^\s,;:]+ (?:is|was|reads) (?P<v>\S{4,})", "strong"),
    _rule("passphrase password passwd", r"(?i)\bpass(?:phrase|word|wd|code) (?P<q>['\"`])(?P<v>[^\r\n'\"`]{4,})(?P=q)", "strong"),
    _rule("mot de passe", r"(?i)\bmots? de passe (?:de|d'|du|pour) ?[^\s:]+\s*(?::|est|=)\s*(?P<v>\S{4,})", "strong"),
    _rule("contrase", r"(?i)\bcontrase(?:ñ|n)a (?:de|para|del) [^\s:]+\s*(?:es|:|=)\s*(?P<v>\S{4,})", "strong"),
    _rule("clave", r"(?i)\bclave (?:de|para|del) [^\s:]+\s*(?:es|:|=)\s*(?P<v>\S{4,})", "strong"),
    _rule("kennwort passwort", r"(?i)\b(?:kennwort|passwort) (?:von|für|zu|des|der) [^\s:]+\s*(?:lautet|ist|:|=)\s*(?P<v>\S{4,})", "strong"),
    _rule("pw password passwd pass", r"(?i)(?:#|//|--|;)\s*(?:pw|pass|passwd|password) (?:for|of) \S+\s*(?:is|:|=|->)\s*(?P<v>\S{4,})", "strong"),
    _rule("login", r"(?i)\blogin:? [^\s:/]+ / (?P<v>\S{4,})", "strong"),
    _rule("login", r"(?i)\blogin:? [^\s:/]+:(?P<v>[^\s/]\S{3,})", "strong"),
    _rule("log in", r"(?i)\blog ?in (?:to \S+ )?as \S+ with (?:password )?(?P<v>\S{4,})", "strong"),
    _rule("token key secret password", r"(?i)\b(?:pasted|use|using|here is|here's|with|sent|share[sd]?)\b[^\r\n.;]{0,40}?\b(?:token|key|secret|password)\b[^\r\n.;]{0,50}?[:=]\s*[`\"']?(?P<v>[^\s`\"']{8,})", "strong"),
    _rule("cred", r"(?i)\bcred(?:s|ential|entials)? (?:for|of) \S+\s*(?:->|=>|:|=|is|are)\s*(?P<v>\S{6,})", "strong"),
]

#: What stands for a secret without being one.
_PLACEHOLDER = re.compile(
    r"(?i)^(?:x{4,}|\*{3,}|\.{3,}|-{4,}|_{4,}|0{6,}|change[_-]?me.*|replace[_-]?(?:me|this).*|your[_-].*|my[_-](?:password|secret|token)|<.*|\[.*\]?|\{\{?.*|\$.*|%[({].*|%\w+%|@\{.*|#\{.*|n/?a|none|null|nil|undefined|true|false|todo\W*|tbd|redacted\W*|masked\W*|hidden|removed|(?:dummy|example|sample|placeholder|fake|test(?:ing)?)(?:[_-].*|[_-]?(?:password|passwd|token|key|secret|value)\d*)?|(?:password|passwd|secret|token|string|str|text|bytes|key|value|required|optional|default|empty|unset)[;,.)]*)$"
)
_MASKED = re.compile(r"\*{5,}|•{2,}|…|x{8,}|X{8,}|\.\.\.|0{12,}|(?i:redacted|placeholder|changeme|change_me|your[-_]|insert[-_])")
_REFERENCE = re.compile(r"\$\{|\$\(|\{\{|%\(|<[A-Za-z]|(?i:\b(?:os\.environ|process\.env|getenv|getpass|vault[.:/]|secrets?\.|env\.|config\.|settings\.|self\.|this\.|args\.|options?\.|params?\.|request\.|ssm:|arn:|data\.|var\.))|^(?:/|\./|~/)(?:[a-z0-9_.-]+/)+[a-z0-9_.-]*$|^[A-Za-z]:\\|^[A-Za-z_][\w.]*\(")
_DIGEST = re.compile(r"(?i)^(?:sha\d*|md5|blake\w*)[:-]|^ssh-|^AAAA[BCE]3|^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$")


#: Characters of a name's end that say what it names (a longer name is known by its end).
NAME_TAIL = 100


def is_live(value: str, shape: str = "any") -> bool:
    """Whether a value in a secret's place is a literal that could be used."""
    if len(value) < 4 or _PLACEHOLDER.match(value) or _MASKED.search(value) or _REFERENCE.search(value) or _DIGEST.search(value):
        return False
    if len(set(value)) < 4:
        return False
    if shape == "random" and (len(value) < 16 or not re.search(r"\d", value) or not re.search(r"[A-Za-z]", value)):
        return False
    if shape == "strong":
        kinds = bool(re.search(r"[a-z]", value)) + bool(re.search(r"[A-Z]", value)) + bool(re.search(r"\d", value)) + bool(re.search(r"[^A-Za-z0-9]", value))
        if value.isdigit() or kinds < 2:
            return False
        if not re.search(r"\d", value):
            # no digit: a capital inside it, or a sign that words don't have
            inner = value.strip(".,;:!?()")
            if not (re.search(r"[a-z][A-Z]|[A-Z][a-z]+[A-Z]|[A-Z]{2}[a-z]", inner) and "." not in inner and "/" not in inner) and not re.search(r"[#%^&*$@!~+=]", inner):
                return False
    return True


_BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def checksum_holds(token: str) -> bool:
    """Whether the last six signs of a prefixed token are the CRC-32, in base 62, of the random part before them."""
    body = token.rpartition("_")[2]
    if len(body) <= 6:
        return False
    value, signs = zlib.crc32(body[:-6].encode()), ""
    for _ in range(6):
        value, digit = divmod(value, 62)
        signs = _BASE62[digit] + signs
    return signs == body[-6:]


def _decoded(part: str) -> bytes:
    try:
        return base64.urlsafe_b64decode(part + "=" * (-len(part) % 4))
    except ValueError:
        return b""


def structure_of(value: str) -> str:
    """What a literal's own structure says: ``checksum``, ``decoded`` (a signed token with a JSON header), ``broken`` (it contradicts itself), or ``shape``."""
    if re.match(r"gh[pousr]_|github_pat_|npm_", value):
        return "checksum" if checksum_holds(value) else "shape"
    if value.startswith("eyJ") and value.count(".") == 2:
        header = _decoded(value.partition(".")[0])
        try:
            return "decoded" if isinstance(json.loads(header), dict) else "broken"
        except ValueError:
            # readable text that is no JSON was never a header; bytes of any kind may be an encrypted or cut one
            return "broken" if header and all(32 <= x < 127 for x in header) else "shape"
    return "shape"


#: Words of messages about passwords, which a passphrase doesn't have.
_ABOUT = frozenset("password passphrase passwort contraseña passe enter invalid required missing wrong incorrect forgot reset change confirm repeat please field hidden show must expired".split())


def is_passphrase(value: str) -> bool:
    """Whether a quoted value with blanks is a phrase of three or more drawn words and no sentence."""
    words = value.split(" ")
    return len(words) >= 3 and all(re.fullmatch(r"[a-zà-ÿ0-9]{2,}", w) and w not in FUNCTION_WORDS and w not in _ABOUT for w in words)


def _name_is_secret(name: str) -> bool:
    return not _OTHER_NAME.search(name) or bool(re.search(r"(?i)access[_-]?key[_-]?id$", name))


class CredentialFinder:
    """Spans of credentials in a text."""

    def __init__(self) -> None:
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        words: dict[str, set[int]] = {}
        for i, (keys, _, _) in enumerate(PLACES):
            for key in keys if keys not in (("mot", "de", "passe"), ("log", "in")) else (" ".join(keys),):
                words.setdefault(key, set()).add(i)
        for key in ("akia", "asia", "abia", "acca", "aida", "aroa", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "github_pat_", "glpat-", "xox", "sk-", "k_live_", "k_prod_", "hf_", "npm_", "aiza", "ya29.", "sg.", "eyj"):
            words.setdefault(key, set()).add(-1)
        words["private key"] = {-2}
        for key in _NAME_KEYS.split():
            words.setdefault(key, set()).add(-3)
        for key in _UNKNOWN_KEYS.split():
            words.setdefault(key, set()).add(-4)
        for key, rules in words.items():
            self.automaton.add_word(key, frozenset(rules))
        self.names: dict[str, bool] = {}
        self.automaton.make_automaton()

    def spans(self, text: str) -> list[tuple[int, int]]:
        """Non-overlapping spans, by start; of overlapping ones the first found by the more certain rule."""
        return [(lo, hi) for lo, hi, _, _ in self.explained(text)]

    def explained(self, text: str) -> list[tuple[int, int, str, str]]:
        """The spans with the rule that found each (``key``, ``issuer``, ``assignment``, ``place``) and what its structure says."""
        called: set[int] = set()
        at: list[int] = []
        for end, rules in self.automaton.iter(text.lower()):
            called |= rules
            if -3 in rules:
                at.append(end)
        if not called:
            return []
        taken: list[tuple[int, int, str, str]] = []

        def take(lo: int, hi: int, rule: str) -> None:
            if hi > lo and all(hi <= a or lo >= b for a, b, _, _ in taken):
                taken.append((lo, hi, rule, structure_of(text[lo:hi])))

        blocked: list[tuple[int, int]] = []
        if -2 in called:
            for pattern in (_PRIVATE, _OPEN_PRIVATE):
                for m in pattern.finditer(text):
                    take(*m.span(), "key")
        if -1 in called:
            for m in _ISSUERS.finditer(text):
                value = m.group()
                said = structure_of(value)
                if said in ("checksum", "decoded") or said != "broken" and is_live(value) and not re.search(r"(?i)[-_](?:test|example|dummy|fake)[-_]", value[:16]):
                    take(*m.span(), "issuer")
                else:
                    blocked.append(m.span())
        for m, shape, phrase in self._assigned(text, at):
            self._value(text, m, shape, blocked, take, "assignment", phrase)
        for i in sorted(x for x in called if x >= 0):
            _, pattern, shape = PLACES[i]
            for m in pattern.finditer(text):
                self._value(text, m, shape, blocked, take, "place", False)
        if -4 in called:
            for m in _UNKNOWN.finditer(text):
                if len(_TURN.findall(m.group())) >= 6 and is_live(m.group()):
                    take(*m.span(), "issuer")
        return sorted(taken)

    def _assigned(self, text: str, ends: list[int]) -> Iterator[tuple[re.Match, str, bool]]:
        """Assignments to names that hold one of the keywords, which end at ``ends``, and whether a passphrase may stand there."""
        done = -1
        for end in ends:
            if end <= done:
                continue
            start = end
            while start > 0 and (text[start - 1].isalnum() or text[start - 1] in "_.-"):
                start -= 1
            run = _RUN.match(text, start)
            if not run:
                continue
            done = run.end() - 1
            if start and text[start - 1] in "$?&":
                continue
            name = run.group().lstrip("_")
            name = name if len(name) <= NAME_TAIL else name[-NAME_TAIL:]
            known = self.names.get(name)
            if known is None:
                if len(self.names) > 100_000:
                    self.names.clear()
                known = self.names[name] = bool(_SECRET_NAME.fullmatch(name)) and _name_is_secret(name)
            if known:
                for pattern, shape in ASSIGNMENTS:
                    m = pattern.match(text, run.end())
                    if m:
                        yield m, shape, bool(re.search(r"(?i)pass|pwd|kennwort|contrase", name))

    @staticmethod
    def _value(text: str, m: re.Match, shape: str, blocked: list[tuple[int, int]], take: Callable[[int, int, str], None], rule: str, phrase: bool) -> None:
        groups = m.groupdict()
        g = "v" if groups.get("v") is not None else "w"
        lo, hi = m.span(g)
        value = text[lo:hi]
        if groups.get("q") is None:
            value = value.rstrip(".,;:)]}")
            hi = lo + len(value)
        scheme = re.match(r"(?i)(?:bearer|basic|token)\s+", value)
        if scheme:
            lo, value = lo + scheme.end(), value[scheme.end() :]
        if any(lo < b and hi > a for a, b in blocked):
            return
        if " " in value:
            if phrase and groups.get("q") is not None and is_passphrase(value):
                take(lo, hi, rule)
        elif is_live(value, shape):
            take(lo, hi, rule)


_KEPT = re.compile(r"-----(?:BEGIN|END) [A-Z0-9 ]+-----|\\u[0-9a-fA-F]{4}|\\.")


def mask(secret: str) -> str:
    """A placeholder of the same length and alphabet.

    Letters become x or X and digits 0; in hexadecimal a or A and 0, in base 32
    A and 2, so what parses such text still does.  Marks of a key, line breaks
    and escapes of the language around stay as they are.
    """
    bare = _KEPT.sub("", secret)
    solid = re.sub(r"[^A-Za-z0-9]", "", bare)
    hexadecimal = bool(re.fullmatch(r"[0-9a-f]{8,}|[0-9A-F]{8,}", solid)) and bool(re.search(r"[A-Fa-f]", solid))
    base32 = bool(re.fullmatch(r"[A-Z2-7]{16,}", solid)) and bool(re.search(r"[2-7]", solid))
    low, up, digit = ("a", "A", "0") if hexadecimal else ("x", "A", "2") if base32 else ("x", "X", "0")

    def cover(text: str) -> str:
        return re.sub(r"[0-9]", digit, re.sub(r"[^\W\d_]", lambda m: up if m.group().isupper() else low, text))

    out, at = [], 0
    for m in _KEPT.finditer(secret):
        out += [cover(secret[at : m.start()]), m.group()]
        at = m.end()
    return "".join([*out, cover(secret[at:])])


def redact(text: str, spans: list[tuple[int, int]]) -> str:
    out, at = [], 0
    for lo, hi in spans:
        out += [text[at:lo], mask(text[lo:hi])]
        at = hi
    return "".join([*out, text[at:]])


def _find() -> Callable[[str], list[tuple]]:
    finder = CredentialFinder()
    return lambda text: list(dict.fromkeys((text[lo:hi],) for lo, hi in finder.spans(text)))


def _redact() -> Callable[[str], list[tuple]]:
    finder = CredentialFinder()

    def look(text: str) -> list[tuple]:
        spans = finder.spans(text)
        return [(redact(text, spans), len(spans))] if spans else []

    return look


def find_credentials(attack_view: DataFrame) -> DataFrame:
    """``request_id``, ``message_index``, ``secret``: every credential of every message, distinct.

    Null ids, messages and contents give nothing; an empty table gives no rows.
    """
    return scan_contents(attack_view, _find, [("secret", "string")]).distinct()


def _explain() -> Callable[[str], list[tuple]]:
    finder = CredentialFinder()
    return lambda text: [(rule, said, hi - lo) for lo, hi, rule, said in finder.explained(text)]


def credential_checks(attack_view: DataFrame) -> DataFrame:
    """How the credentials were found: ``rule``, ``structure``, ``n_places`` and ``n_characters`` over all deliveries."""
    each = scan_contents(attack_view, _explain, [("rule", "string"), ("structure", "string"), ("size", "int")])
    return each.groupBy("rule", "structure").agg(F.count("*").alias("n_places"), F.sum("size").alias("n_characters"))


def redacted_messages(attack_view: DataFrame) -> DataFrame:
    """The messages that hold credentials, with placeholders in their place.

    ``request_id``, ``message_index``, ``content`` and ``n_secrets``; distinct.
    """
    return scan_contents(attack_view, _redact, [("content", "string"), ("n_secrets", "int")]).groupBy("request_id", "message_index").agg(F.min("content").alias("content"), F.max("n_secrets").alias("n_secrets"))
