"""Credentials in source code and configuration: where they stand, and texts with placeholders in their place.

One deterministic automaton (Aho-Corasick over token prefixes, key armor, the marks of connection strings and the words
that name secrets) passes over a text once. Around each hit a window is cut; windows overlap, however long the line, and
in each the grammars of tokens, authorisation values, connection strings and named literals are tried. Spans are kept in
absolute positions, so what two windows see counts once; redaction splices placeholders into the spans from the end.
"""

from __future__ import annotations

import base64
import binascii
import re
from functools import lru_cache
from typing import NamedTuple

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Published token formats, by prefix.
TOKENS = (
    r"(?:AKIA|ASIA|ABIA|ACCA)[A-Z0-9]{16}",
    r"gh[pousr]_[A-Za-z0-9]{30,}",
    r"github_pat_[A-Za-z0-9_]{40,}",
    r"glpat-[A-Za-z0-9_\-]{20,}",
    r"npm_[A-Za-z0-9]{30,}",
    r"xox[abeoprs]-[A-Za-z0-9\-]{16,}",
    r"xapp-[A-Za-z0-9\-]{20,}",
    r"(?:sk|rk|pk_secret)_(?:live|test)_[A-Za-z0-9]{16,}",
    r"sk-(?:proj-|ant-)?[A-Za-z0-9_\-]{24,}",
    r"whsec_[A-Za-z0-9+/=]{20,}",
    r"do[opr]_v1_[a-f0-9]{40,}",
    r"AIza[A-Za-z0-9_\-]{33,}",
    r"ya29\.[A-Za-z0-9_\-]{20,}",
    r"SG\.[A-Za-z0-9_\-]{16,}\.[A-Za-z0-9_\-]{32,}",
    r"hf_[A-Za-z0-9]{30,}",
    r"pypi-[A-Za-z0-9_\-]{40,}",
    r"shp(?:at|ca|pa|ss)_[a-fA-F0-9]{32}",
    r"sq0(?:atp|csp)-[A-Za-z0-9_\-]{22,}",
    r"dckr_pat_[A-Za-z0-9_\-]{20,}",
    r"lin_api_[A-Za-z0-9]{32,}",
    r"hvs\.[A-Za-z0-9_\-]{24,}",
    r"NRAK-[A-Z0-9]{27}",
    r"PMAK-[a-f0-9]{24}-[a-f0-9]{34}",
    r"dapi[a-f0-9]{32}",
    r"eyJ[A-Za-z0-9_\-]{8,}\.eyJ[A-Za-z0-9_\-]{8,}\.[A-Za-z0-9_\-]{10,}",
)
#: What a key is of, where its name says that it is secret.
_KEY_OF = "api access secret private signing signature signatur encryption salt master auth service licence license shared account jwt".split()
# What the automaton looks for, in lower case; every name that secret_name() takes holds one of them.
ANCHORS = (
    "akia asia abia acca ghp_ gho_ ghu_ ghs_ ghr_ github_pat_ glpat- npm_ xoxa- xoxb- xoxe- xoxo- xoxp- xoxr- xoxs- xapp- sk_live_ sk_test_ rk_live_ rk_test_ sk- whsec_ doo_v1_ dop_v1_ dor_v1_ aiza ya29. sg. hf_ "
    "pypi- shpat_ shpca_ shppa_ shpss_ sq0atp- sq0csp- dckr_pat_ lin_api_ hvs. nrak- pmak- dapi eyj :// bearer basic passw passphrase passwort pwd contrase contrasen mot_de_passe motdepasse senha kennwort secret "
    "token signing cred auth _pass _pw pw pass login psk pin"
).split() + [f"{of}{mark}key" for of in _KEY_OF for mark in ("", "_", "-", ".", "__", " ")]
#: Anchors that count only where they are a word of a name by themselves, as secret_name() takes them.
_WHOLE = frozenset("psk pin".split())
#: Parts of a name that say that its value is secret.
SECRET_NAME = re.compile(
    r"passw(?:or[dt]|d)?|passwd|passphrase|pwd|contrase(?:n|ñ|ni)a|contrasena|motdepasse|senha|kennwort|secrets?|tokens?|apikeys?|accesskey|accountkey|sharedkey|privatekey|secretkey|signingkey|signing|signature?key|saltkey|encryptionkey|masterkey|licen[cs]ekey|servicekey|authkey|credentials?|creds?"
)
_SHORT_NAMES = frozenset("pw pass auth psk pin".split())
#: Words that hold a mark of a secret by chance.
_CHANCE = re.compile("massacred|sacred|accredit|credit|credib|credul|credence")
#: Last words of names that only speak of a secret.
_ABOUT = frozenset(
    "file path dir folder label field policy ttl name names length len count max min type kind expiry expires expiration hint placeholder prompt regex pattern header param column env var variable url uri endpoint enabled required size limit span index "
    "id ids age strategy provider format prefix suffix mode store class manager service rotation timeout version algorithm alg error message msg help text title description tokenizer hash digest checksum sha fingerprint public ref reference arn".split()
)
_PLACEHOLDER = re.compile(
    r"(?i)^(?:x{3,}|\*+|\.{3,}|-+|_+|#+|•+|change[_\-]?(?:me|it|this)\S*|your[_\-]?\S*|my[_\-]?(?:secret|password|token|key)\S*|replace[_\-]?\S*|insert[_\-]\S*|todo\S*|fixme\S*|dummy\S*|placeholder\S*|example\S*|sample|redacted\S*|masked|hidden|none|null|nil|undefined|true|false|test|secret|password|passwd|pwd|pass|token|admin|root|user|default|unset|empty|string)$"
)
_REFERENCE = re.compile(r"^(?:\$|%\(|%[A-Z_]+%|\{|<|@|&|\*[A-Za-z]|/|\./|\.\./|~|file:|env[:.(]|vault[:/]|ssm:|arn:|secret[s]?[:/.]|process\.env|os\.|getenv|System\.|ENV\[|var\.|local\.|data\.|[a-z]+://(?![^/]*:[^/]*@))", re.I)
_UUID = re.compile(r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$")
_DIGEST = re.compile(r"(?i)^(?:sha\d+|md5|blake\w*)[:\-]")

_TOKEN = re.compile("(?<![A-Za-z0-9_])(?:" + "|".join(TOKENS) + ")(?![A-Za-z0-9_])")
#: A token of no published format: a short lower-case mark, a separator and a long run of mixed characters.
_UNKNOWN_TOKEN = re.compile(r"(?<![\w./+=\-@])[a-z][a-z0-9]{1,9}[._][A-Za-z0-9]{24,}(?![\w/+=])")
_URL = re.compile(r"(?<![A-Za-z0-9+.\-])[A-Za-z][A-Za-z0-9+.\-]*://([^\s/:@\"'`<>]*):([^\s/@\"'`<>]+|(?:(?!://)[^\s@\"'`<>])*?)@(?=[A-Za-z0-9\[$\{])")
_BEARER = re.compile(r"(?i)\b(bearer|token)\s+([A-Za-z0-9_\-.=+/]{16,})")
_BASIC = re.compile(r"(?i)\bbasic\s+([A-Za-z0-9+/_\-]{8,}={0,2})")
_ARMOR = re.compile(r"-----BEGIN ((?:[A-Z0-9]+ )*)PRIVATE KEY(?: BLOCK)?-----")
_KEY_BODY = re.compile(r"(?:\\[nrt]|\s|[\"'`+,;|\\]|\#|//|--(?!-)|\*|(?:Proc-Type|DEK-Info|Version|Comment)[^\n]*|[A-Za-z0-9+/=])*")
_NAMED = re.compile(  # a name begins where no other does, so a long run of its characters is read once
    r"(?<![\w.])(?<![\w.]-)(?P<name>[\w][\w.\-]*+)(?P<mid>[\"']?\]?\s*(?::[^\S\n]*[A-Za-z_][\w<>\[\]| ]{0,30}?)?(?:\s|\\\r?\n)*(?::=|=>|=(?!=)|:)(?:[\s(]|\\\r?\n)*|[\"'][^\S\n]*,[^\S\n]*|[^\S\n]+(?=[\"']))(?P<mark>[rbfu]?(?:\"\"\"|'''|[\"'`]))(?P<value>(?:(?!(?P=q1))[^\n\\]|\\(?:.|\r?\n))*)"
    .replace("(?P=q1)", r"[\"'`]")
)
_BARE = re.compile(r"^[^\S\n]*(?:(?:#|//|--|;|-)\s*)?(?:(?P<lead>export|ENV|ARG|set|setx|SET|declare -x)\s+)?(?P<name>[A-Za-z_][\w.\-]*)(?:=|:[^\S\n]+|[^\S\n]+=[^\S\n]*)(?P<value>[^\s\"'`,;(){}\[\]]+)[^\S\n]*(?:\\|#.*)?$", re.M)
_XML = re.compile(r"<(?P<name>[A-Za-z_][\w.\-]*)>(?P<value>[^<>\s]+)</")
_OPTION = re.compile(r"(?<![\w\-])--?(?P<name>[a-z][a-z\-]*)[= ](?P<value>[^\s\"'`$]+)")
_PROSE = re.compile(r"(?i)\b(?:password|passwd|passwort|passphrase|pwd|pw|pass|login|credentials?|kennwort|contrase\S{1,3}a|mot de passe|secret|token|api key)\b[^\n\"'`=]{0,60}?(?:[:/]|\b(?:is|was|ist|war|es|est|are|now)\b)[^\S\n]*(?P<value>[^\s\"'`<>(),]{8,})[^\S\n]*(?:-->|\*/|\.)?[^\S\n]*$", re.M)
#: From one part of a literal to the next: quotes with an operator or blanks between, over line ends too.
_SECOND_PART = re.compile(r"[\"'`]\s*(?:\\\r?\n\s*)?(?P<op>\+|\.\.|\.|&(?:[^\S\n]*_(?=\r?\n))?|\|\|)?\s*(?:\\\r?\n\s*)?(?:(?<=[\s+])[rbfuRBFU](?=[\"'`]))?[\"'`]")
_PART = re.compile(r"(?:[^\"'`\n\\]|\\(?:.|\r?\n))*(?=[\"'`])")
_LINE_MARK = re.compile(r"\\\r?\n[^\S\n]*")
#: What stands in a joined literal besides its parts.
_SEAM = re.compile(f"({_SECOND_PART.pattern.replace('?P<op>', '?:')}|{_LINE_MARK.pattern})")
#: Blank lines, operators and brackets from a line's end to a quote.
_TO_QUOTE = re.compile(r"\s*(?P<op>(?:(?:[=+.&|:(]|\\(?=\r?\n))\s*)*)[rbfuRBFU]?[\"'`]")


class Span(NamedTuple):
    start: int
    end: int
    kind: str


def secret_name(name: str) -> bool:
    """Whether a variable of this name holds a secret itself, whatever the name's style."""
    parts = [p.lower() for p in re.findall(r"[A-Z]+(?![a-z])|[A-Z]?[a-zà-ɏ]+|\d+", name)]
    if not parts or parts[-1] in _ABOUT or (len(parts) > 1 and parts[-1].isdigit() and parts[-2] in _ABOUT):
        return False
    flat = "".join(_CHANCE.sub("", p) for p in parts)
    return bool(SECRET_NAME.search(flat)) or any(p in _SHORT_NAMES for p in parts) or (parts[-1] == "key" and len(parts) > 1 and parts[-2] in _KEY_OF)


def literal(value: str) -> bool:
    """Whether a value may be a secret itself: no reference, mask, placeholder, id, path, number or plain word."""
    v = value.strip()
    if len(v) < 6 or re.search(r"\s", v) or _PLACEHOLDER.match(v) or _REFERENCE.match(v) or _UUID.match(v) or _DIGEST.match(v):
        return False
    if "${" in v or "{{" in v or "$(" in v or re.search(r"\*{4,}|x{6,}|X{6,}|\.\.\.", v) or "EXAMPLE" in v:
        return False
    lower, upper, digit = (bool(re.search(p, v)) for p in ("[a-z]", "[A-Z]", "[0-9]"))
    other = bool(re.search(r"[^A-Za-z0-9_\-.]", v))
    if digit and not (lower or upper):
        return False
    if lower and upper and not digit and not other:
        # words in camel or title case are names, anything else in both cases isn't
        return len(v) >= 12 and not re.fullmatch(r"(?:[A-Z]?[a-z]+)(?:[_\-.]?[A-Z][a-z]+|[_\-.][a-z]+)*|[A-Z][A-Z0-9_]*", v)
    return lower + upper + digit + other >= 2 and (digit or other) and len(set(v)) >= 5


def strong(value: str) -> bool:
    """A value that no prose holds: long enough, in both cases, with a digit or sign, or jumbled case."""
    if not literal(value) or len(value) < 10 or "/" in value and not re.search(r"[0-9]", value):
        return False
    return bool(re.search("[a-z]", value) and re.search("[A-Z]", value) and (re.search("[0-9]", value) or re.search(r"[a-z][A-Z]{3,}|[!#*?+$%&@]", value)))


def mixed(token: str) -> bool:
    """A random-looking run: many characters of each class."""
    body = re.split(r"[._]", token, maxsplit=1)[-1]
    return all(len(re.findall(p, body)) >= 3 for p in ("[a-z]", "[A-Z]", "[0-9]")) and len(set(body)) >= 12


@lru_cache(maxsize=1)
def automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for w in ANCHORS:
        a.add_word(w, (w in _WHOLE, len(w)))
    a.make_automaton()
    return a


#: Characters of a long line on either side of a hit; a window's right end then moves on to the next blank.
WIDTH = 4096
_BLANK = re.compile(r"\s")


def _goes_on(text: str, z: int) -> int:
    """The end of the line at z, or of a later one if a literal is still to come or goes on there."""
    while text[z : z + 1] == "\n":
        k = z - 1
        while k >= 0 and text[k] in " \t\r":
            k -= 1
        if k < 0 or text[k] == "\n":
            break
        if text[k] == "\\":
            at = z + 1
        elif (m := _TO_QUOTE.match(text, z)) and (text[k] in "=:(+.&|_\"'`" or m.group("op")[:1] in tuple("=+.&|:")):
            at = m.end()
        else:
            break
        z = text.find("\n", at)
        if z < 0:
            return len(text)
    return z


def _windows(text: str) -> list[tuple[int, int]]:
    """Stretches of text around the automaton's hits: whole lines where they are short, overlapping cuts of long ones.

    A cut ends at a blank, so it holds the whole of a value however long, for no value holds one; a line whose literal
    begins or goes on below takes the lines that hold it. A hit well inside the last window makes none of its own."""
    low = text.lower()
    if len(low) != len(text):
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    out: list[tuple[int, int]] = []
    for last, (whole, size) in automaton().iter(low):
        first = last - size + 1
        if whole and (text[last + 1 : last + 2].islower() or text[first].islower() and text[first - 1 : first].isalpha()):
            continue
        if out and out[-1][0] + 1024 <= first < out[-1][1] - 1024 or out and first < out[-1][1] and text[out[-1][1] : out[-1][1] + 1] in ("\n", ""):
            continue
        a = text.rfind("\n", max(0, first - WIDTH), first) + 1 or max(0, first - WIDTH)
        z = text.find("\n", last, last + WIDTH)
        if z < 0:
            m = _BLANK.search(text, last + WIDTH)
            z = m.start() if m else len(text)
        z = _goes_on(text, z)
        if not out or out[-1] != (a, z):
            out.append((a, z))
    return out


def _keys(text: str) -> list[Span]:
    """Private keys in armor that have a body, from BEGIN to END (or as far as the body goes)."""
    out = []
    for m in _ARMOR.finditer(text):
        stop = text.find("-----END", m.end())
        if stop < 0 or 0 <= text.find("-----BEGIN", m.end(), stop):  # none, or the end of another
            stop = _KEY_BODY.match(text, m.end()).end()
        body = re.sub(r"\\[nrt]|[^A-Za-z0-9+/=]", "", text[m.end() : stop])
        if len(body) >= 32 and max(map(len, re.findall(r"[A-Za-z0-9+/=]+", text[m.end() : stop])), default=0) >= 16 and len(set(body)) > 8:
            end = text.find("-----", stop + 5) + 5 if text.startswith("-----END", stop) else stop
            out.append(Span(m.start(), max(end, stop), "private_key"))
    return out


def _joined(w: str, m: re.Match) -> tuple[str, int]:
    """A named literal with the parts that code joins to it, and where the last one ends."""
    value, end, mid = _LINE_MARK.sub("", m.group("value")), m.end("value"), m.group("mid")
    alone = literal(value)
    while value and len(m.group("mark").lstrip("rbfu")) == 1 and (n := _SECOND_PART.match(w, end)) and (part := _PART.match(w, n.end())) and part.group():
        if not n.group("op"):
            blank = n.group()[1:-1]
            if blank and alone and not ("(" in mid or re.search(r"\s[:=]|[:=]>?\s", mid)):
                break  # another word of a command
            if "\n" in blank and "(" not in mid and "\\" not in blank and re.match(r"[\"'`]\s*[:=]", w[part.end() :]):
                break  # a quoted name in the next line
        value += _LINE_MARK.sub("", part.group())
        end = part.end()
    return value, end


def _in_window(w: str) -> list[Span]:
    out = [Span(m.start(), m.end(), "token") for m in _TOKEN.finditer(w) if "EXAMPLE" not in m.group() and len(set(m.group())) >= 8]
    if "://" in w:
        for m in _URL.finditer(w):
            p = m.group(2)
            if not (_PLACEHOLDER.match(p) or re.match(r"[$%{<\[(]|\*+$|:", p) or "${" in p or "{{" in p or not re.search("[A-Za-z0-9]", p)) and len(p) >= 4:
                out.append(Span(m.start(2), m.end(2), "url_password"))
    for m in _BEARER.finditer(w):
        if mixed("." + m.group(2)) or (m.group(1).lower() == "bearer" and strong(m.group(2))):
            out.append(Span(m.start(2), m.end(2), "authorization"))
    for m in _BASIC.finditer(w):
        try:
            plain = base64.b64decode(m.group(1) + "=" * (-len(m.group(1)) % 4)).decode()
        except (binascii.Error, UnicodeDecodeError):
            continue
        user, colon, password = plain.partition(":")
        if colon and plain.isprintable() and len(password) >= 4 and not _PLACEHOLDER.match(password) and not _REFERENCE.match(password):
            out.append(Span(m.start(1), m.end(1), "authorization"))
    for m in _NAMED.finditer(w):
        if not secret_name(m.group("name")):
            continue
        value, mid, end = m.group("value"), m.group("mid"), m.end("value")
        whole, stop = _joined(w, m)
        if not (literal(_LINE_MARK.sub("", value)) or stop > end and literal(whole)):
            continue
        if value.endswith(("(", "=")) and len(value) < 12 and stop == end:
            continue
        after = re.match(r"[\"'`]\s*([:=,]?)", w[stop:])
        if after and (after.group(1) == "," and "(" in mid or after.group(1) in (":", "=") and "\n" in mid):
            continue  # one of several values, or a name below
        out.append(Span(m.start("value"), stop, "literal"))
    for m in _BARE.finditer(w):
        v = m.group("value")
        if secret_name(m.group("name")) and literal(v) and (m.group("lead") or m.group("name").isupper() or not re.fullmatch(r"[A-Za-z_]\w*(?:\.[A-Za-z_]\w*)*", v) or strong(v)):
            out.append(Span(m.start("value"), m.end("value"), "literal"))
    for pattern in (_XML, _OPTION):
        for m in pattern.finditer(w):
            if secret_name(m.group("name")) and strong(m.group("value")):
                out.append(Span(m.start("value"), m.end("value"), "literal"))
    for m in _PROSE.finditer(w):
        if strong(m.group("value")) and "://" not in m.group("value"):
            out.append(Span(m.start("value"), m.end("value"), "literal"))
    return out


def spans(text: str | None) -> list[Span]:
    """Places of credentials in a text, in order, without overlap; none for a null or empty text."""
    if not text:
        return []
    found = set(_keys(text)) if "-----BEGIN" in text else set()
    for a, z in _windows(text):
        found |= {Span(a + s.start, a + s.end, s.kind) for s in _in_window(text[a:z])}
    found |= {Span(m.start(), m.end(), "token") for m in _UNKNOWN_TOKEN.finditer(text) if mixed(m.group()) and not _DIGEST.match(m.group()) and not re.match(r"sha\d", m.group())}
    out: list[Span] = []
    for s in sorted(found, key=lambda s: (s.start, -s.end)):
        if not out or s.start >= out[-1].end:
            out.append(s)
    return out


def lines(text: str | None) -> list[int]:
    """1-based numbers of the lines where credentials begin, once each."""
    out, line, at = [], 1, 0
    for s in spans(text):
        line += text.count("\n", at, s.start)
        at = s.start
        if not out or out[-1] != line:
            out.append(line)
    return out


def splice(text: str, found: list[Span]) -> str:
    """The text with REDACTED for each span; of a key in armor only the body goes, line by line, of joined literals each part."""
    out, at = [], 0
    for s in found:
        value = text[s.start : s.end]
        if s.kind == "private_key":
            value = re.sub(r"(-----BEGIN [A-Z0-9 ]+-----)(.*?)(-----END|$)", lambda m: m[1] + re.sub(r"(?<!\\)[A-Za-z0-9+/=]{8,}", "REDACTED", m[2].replace("\\n", "\\n\0")).replace("\0", "") + m[3], value, flags=re.S)
        elif s.kind == "literal" and _SEAM.search(value):
            value = "".join(p if k % 2 or not p else "REDACTED" for k, p in enumerate(_SEAM.split(value)))
        else:
            value = "REDACTED"
        out += [text[at : s.start], value]
        at = s.end
    return "".join(out) + text[at:]


def redact(text: str | None) -> str | None:
    """The text with its credentials spliced out; null stays null."""
    return text if not text else splice(text, spans(text))


def redact_variable(name: str | None, value: str | None) -> tuple[str | None, int]:
    """An environment variable's value without its credentials, and how many those were."""
    if not secret_variable(name, value):
        return value, 0
    found = spans(value)
    if not found and name:
        n = len(name) + 1
        found = [Span(s.start - n, s.end - n, s.kind) for s in spans(f"{name}={value}") if s.start >= n]
    return (splice(value, found), len(found)) if found else ("REDACTED", 1)


def secret_variable(name: str | None, value: str | None) -> bool:
    """Whether an environment variable holds a credential."""
    if not value:
        return False
    return bool(name and secret_name(name) and literal(value)) or bool(spans(value)) or bool(spans(f"{name or ''}={value}"))


_REDACTED = ["origin", "row_id", "part", "text", "n_redacted"]
_REDACTED_SCHEMA = "origin string, row_id long, part string, text string, n_redacted int"


def found_in_text(df: DataFrame, origin: str, id_col: str, text_col: str) -> DataFrame:
    """(origin, row_id, locator) of each line that begins a credential; null texts have none. No shuffle."""

    def run(batches):
        for b in batches:
            rows = [(i, n) for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for n in lines(t)]
            yield pa.RecordBatch.from_arrays([pa.array([origin] * len(rows), pa.string()), pa.array([r[0] for r in rows], pa.int64()), pa.array([str(r[1]) for r in rows], pa.string())], names=["origin", "row_id", "locator"])

    return df.select(F.col(id_col).cast("long").alias("row_id"), F.col(text_col).alias("text")).mapInArrow(run, "origin string, row_id long, locator string")


def found_in_variables(df: DataFrame, origin: str, id_col: str, map_col: str) -> DataFrame:
    """(origin, row_id, locator) of each variable of a map that holds a credential; null maps have none. No shuffle."""

    def run(batches):
        for b in batches:
            rows = [(i, k) for i, k, v in zip(*(c.to_pylist() for c in b.columns)) if secret_variable(k, v)]
            yield pa.RecordBatch.from_arrays([pa.array([origin] * len(rows), pa.string()), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string())], names=["origin", "row_id", "locator"])

    return df.select(F.col(id_col).cast("long").alias("row_id"), F.explode(map_col)).mapInArrow(run, "origin string, row_id long, locator string")


def redacted(df: DataFrame, origin: str, id_col: str, text_col: str) -> DataFrame:
    """(origin, row_id, part, text, n_redacted): every row, credentials replaced, all else as it was; null texts stay null."""

    def run(batches):
        for b in batches:
            done = [(t, 0) if not t else (splice(t, found := spans(t)), len(found)) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([origin] * len(done), pa.string()), b.column(0), pa.nulls(len(done), pa.string()), pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], pa.int32())], names=_REDACTED)

    return df.select(F.col(id_col).cast("long").alias("row_id"), F.col(text_col).alias("text")).mapInArrow(run, _REDACTED_SCHEMA)


def redacted_variables(df: DataFrame, origin: str, id_col: str, map_col: str) -> DataFrame:
    """(origin, row_id, part, text, n_redacted): a row for each variable of a map, part its name; null and empty maps have none."""

    def run(batches):
        for b in batches:
            done = [redact_variable(k, v) for k, v in zip(b.column(1).to_pylist(), b.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array([origin] * len(done), pa.string()), b.column(0), b.column(1), pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], pa.int32())], names=_REDACTED)

    return df.select(F.col(id_col).cast("long").alias("row_id"), F.explode(map_col)).mapInArrow(run, _REDACTED_SCHEMA)
