"""Tokens of several languages, read chunk by chunk, and what a chunk does to the lexer's state and to the brackets.

A chunk is read from the state in which the one before it ended (inside a comment, a string of several lines, a template)
and gives tokens, its last state, and a summary of its brackets: the closing ones that nothing in it opens, then the
opening ones that nothing in it closes. Summaries combine associatively; what they leave of a whole file says whether its
brackets are balanced, and no other step asks that. Where the first state isn't known, as the chunks before lie in another
partition, a chunk's effect is a map from each state to the last state and the summary; effects combine associatively too.
"""

from __future__ import annotations

import re
from functools import reduce


class Broken(Exception):
    """The text is not valid in its language."""


#: Characters of a chunk; it ends with the line in which they are reached.
CHUNK = 1 << 10
PAIRS = {")": "(", "]": "[", "}": "{"}
_CUT = re.compile(r"(?<!\\)\n")


def chunks(text: str, size: int = CHUNK) -> list[str]:
    """Pieces of whole lines of about ``size`` characters; a line of any length stays whole, a continued line goes on."""
    out, start = [], 0
    while len(text) - start > size:
        m = _CUT.search(text, start + size)
        cut = m.end() if m else len(text)
        out.append(text[start:cut])
        start = cut
    if start < len(text) or not out:
        out.append(text[start:])
    return out


# -- tokens ----------------------------------------------------------------------------------------------------------
# A token is its text; names, numbers and strings are told by their first character ("a" kind letters, "0", '"').

NAME, NUMBER, STRING, OP, END = "n", "0", "s", "o", "e"
Summary = tuple[list[int], list[int]]  # places of closing brackets without a partner, and of opening ones


class Tokens:
    """Parallel lists of kinds, texts and whether a line break stands before; match gives the partner of a bracket."""

    __slots__ = ("kind", "text", "broke", "match", "templates", "open_line")

    def __init__(self) -> None:
        self.kind: list[str] = []
        self.text: list[str] = []
        self.broke: list[bool] = []
        self.match: dict[int, int] = {}
        self.templates: list[int] = []  # depth of braces inside each open ${ of JavaScript
        self.open_line = True

    def add(self, kind: str, text: str, broke: bool) -> None:
        self.kind.append(kind), self.text.append(text), self.broke.append(broke)

    def _pair(self, opening: int, closing: int) -> None:
        if PAIRS[self.text[closing]] != self.text[opening][-1]:
            raise Broken("unmatched " + self.text[closing])
        self.match[opening] = closing
        self.match[closing] = opening

    def summary(self, first: int) -> Summary:
        """Of the tokens from ``first`` on; pairs within them are matched."""
        closing: list[int] = []
        stack: list[int] = []
        for i in range(first, len(self.kind)):
            if self.kind[i] == OP:
                t = self.text[i]
                if t in ("(", "[", "{", "${"):
                    stack.append(i)
                elif t in (")", "]", "}"):
                    if stack:
                        self._pair(stack.pop(), i)
                    else:
                        closing.append(i)
        return closing, stack

    def join(self, a: Summary, b: Summary) -> Summary:
        """The summary of one stretch of tokens after another; associative. Pairs across the two are matched."""
        n = min(len(a[1]), len(b[0]))
        for k in range(n):
            self._pair(a[1][-1 - k], b[0][k])
        return a[0] + b[0][n:], a[1][: len(a[1]) - n] + b[1]


def read(lang: str, text: str, size: int = CHUNK) -> Tokens:
    """Tokens of a whole text with their brackets matched, an END token last."""
    lexer, out, state, summaries = LEXERS[lang], Tokens(), "", []
    for chunk in chunks(text, size):
        first = len(out.kind)
        state = lexer(out, chunk, state)
        summaries.append(out.summary(first))
    if state or out.templates:
        raise Broken("unclosed " + (state or "template"))
    if lang == "go":
        _line_end(out)
    if not balanced_summary(reduce(out.join, summaries)):
        raise Broken("brackets")
    out.add(END, "", True)
    return out


def balanced_summary(s: Summary) -> bool:
    return not s[0] and not s[1]


# -- effects of chunks whose first state isn't known -------------------------------------------------------------------

#: Per language the states in which a chunk may begin. SQL has more: comments nest, and a body's tag is its state.
STATES = {"java": ["", "/*", '"""'], "go": ["", "/*", "`"], "sql": ["", "'", "e'", '"', *(f"/*{n}" for n in range(1, 9))]}
Effect = dict[str, tuple[str, str, str]]  # state before -> (state after, unmatched closing, unmatched opening)
FAILED, UNSURE = "!", "?"


def effect(lang: str, chunk: str, states: list[str] | None = None) -> Effect:
    """What a chunk does from each state; a tag of SQL that the chunk doesn't hold is left out and stays as it is."""
    out: Effect = {}
    if states is None:
        states = STATES[lang] + (sorted(set(_TAG.findall(chunk))) if lang == "sql" else [])
    for first in states:
        t = Tokens()
        try:
            last = LEXERS[lang](t, chunk, first)
            closing, opening = t.summary(0)
            out[first] = (last, "".join(t.text[i] for i in closing), "".join(t.text[i] for i in opening))
        except Broken:
            out[first] = (FAILED, "", "")
    return out


def combine(a: Effect, b: Effect) -> Effect:
    """The effect of one stretch of text after another; associative."""
    out: Effect = {}
    for first in a if not any(k[0] == "$" for k in b if k) else dict.fromkeys([*a, *(k for k in b if k[:1] == "$")]):
        mid, closing, opening = a.get(first, (first, "", ""))
        if mid in (FAILED, UNSURE):
            out[first] = (mid, "", "")
            continue
        last, closing2, opening2 = b.get(mid, (mid if mid[:1] == "$" else UNSURE, "", ""))
        n = min(len(opening), len(closing2))
        if last in (FAILED, UNSURE):
            out[first] = (last, "", "")
        elif any(PAIRS[c] != o for c, o in zip(closing2[:n], reversed(opening))):
            out[first] = (FAILED, "", "")
        else:
            out[first] = (last, closing + closing2[n:], opening[: len(opening) - n] + opening2)
    return out


def balanced(e: Effect) -> bool | None:
    """Whether a whole file's effect leaves nothing open; None where the states of effects don't reach."""
    state, closing, opening = e[""]
    return None if state == UNSURE else not state and not closing and not opening


# -- lexers: each appends a chunk's tokens and returns the state in which the chunk ends --------------------------------

_NAMES = r"[^\W\d][\w$]*"
_JS = re.compile(
    rf"[^\S\n]*(?:(?P<blank>//[^\n]*|\n+)|(?P<long>/\*.*?\*/)|(?P<name>[$#@]?(?:[^\W\d]|\$)[\w$]*)|(?P<num>0[xXbBoO][\da-fA-F_]+n?|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d+)?n?)"
    r"|(?P<str>\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*')|(?P<op>>>>=|\.\.\.|===|!==|\*\*=|<<=|>>=|&&=|\|\|=|\?\?=|=>|==|!=|<=|>=|&&|\|\||\?\?|\?\.(?!\d)|\+\+|--|\+=|-=|\*=|/=|%=|&=|\|=|\^=|<<|\*\*|[-+*/%=<>!&|^~?:;,.()\[\]{}`])|(?P<end>\Z))",
    re.S,
)
_REGEX = re.compile(r"/(?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[a-z]*")
_TEMPLATE = re.compile(r"(?:[^`\\$]|\\.|\$(?!\{))*", re.S)
_KINDS = {"name": NAME, "num": NUMBER, "str": STRING, "op": OP}
_BEFORE_REGEX = frozenset("return typeof instanceof in of new delete void throw case do else await yield default".split())


def javascript(out: Tokens, text: str, state: str = "") -> str:
    """JavaScript or TypeScript; a template is STRING parts and ${ } around its expressions. A chunk is read from known
    states only, as the templates that are open around it are no finite state."""
    at, broke, n = 0, out.open_line, len(text)
    kind, texts, brokes, templates = out.kind, out.text, out.broke, out.templates
    if not texts and not state and text.startswith("#!"):
        at = text.find("\n") if "\n" in text else n
    match = _JS.match
    if state == "/*":
        at = text.find("*/") + 2
        if at < 2:
            return state
        broke = True
    while at < n:
        if state == "`":  # on in a template that an earlier chunk began
            token, group = "`+", "op"
        else:
            m = match(text, at)
            if not m:
                raise Broken(f"character {text[at]!r}")
            at, group = m.end(), m.lastgroup
            if group == "blank":
                broke = broke or text[at - 1] == "\n"
                continue
            if group == "end":
                break
            token = m[group]
            if group == "long":
                broke = broke or "\n" in token
                continue
        if group == "op":
            if token[0] == "/":
                first = m.start("op")
                if text.startswith("/*", first):
                    return "/*"
                last, before = (texts[-1], kind[-1]) if texts else ("", OP)
                if (before == OP and last not in (")", "]", "}", "++", "--")) or (before == NAME and last in _BEFORE_REGEX) or not texts or (last in (")", "}") and broke and _REGEX.match(text, first)):
                    m = _REGEX.match(text, first)
                    if not m:
                        raise Broken("regular expression")
                    out.add(STRING, "/r/", broke)
                    at, broke = m.end(), False
                    continue
            if token in ("`", "`+") or (token == "}" and templates and templates[-1] == 0):
                if token == "}":
                    out.add(OP, "}", broke)
                    templates.pop()
                m = _TEMPLATE.match(text, at)
                at = m.end()
                if state != "`":
                    out.add(STRING, "`" if token == "`" else "`+", broke)
                state = ""
                if text.startswith("${", at):
                    out.add(OP, "${", False)
                    templates.append(0)
                    at += 2
                elif at < n:
                    at += 1
                else:
                    return "`"
                broke = False
                continue
            if templates:
                templates[-1] += (token == "{") - (token == "}")
        elif group == "num" and at < n and (text[at].isalnum() or text[at] == "_"):
            raise Broken("number")
        kind.append(_KINDS[group])
        texts.append(token)
        brokes.append(broke)
        broke = False
    out.open_line = broke
    return ""


_JAVA = re.compile(
    rf"\s*(?:(?P<blank>//[^\n]*|/\*.*?\*/)|(?P<name>(?:[^\W\d]|\$)[\w$]*)|(?P<num>(?:0[xX][\da-fA-F_]+|0[bB][01_]+|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d+)?)[lLfFdD]?)"
    r"|(?P<str>\"\"\"\s*?\n(?:[^\\]|\\.)*?\"\"\"|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\u+[\da-fA-F]{4}|\\[0-7]{1,3}|\\.)')|(?P<op>>>>=|<<=|>>=|\.\.\.|->|::|==|!=|<=|>=|&&|\|\||\+\+|--|\+=|-=|\*=|/=|%=|&=|\|=|\^=|<<|[-+*/%=<>!&|^~?:;,.()\[\]{}@])|(?P<end>\Z))",
    re.S,
)
_GO = re.compile(
    rf"[^\S\n]*(?:(?P<line>\n|//[^\n]*)|(?P<long>/\*.*?\*/)|(?P<name>{_NAMES})|(?P<num>(?:0[xXbBoO][\da-fA-F_]+|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d+)?)i?)"
    r"|(?P<str>\"(?:[^\"\\\n]|\\.)*\"|`[^`]*`|'(?:[^'\\\n]|\\x[\da-fA-F]{2}|\\u[\da-fA-F]{4}|\\U[\da-fA-F]{8}|\\[0-7]{3}|\\.)')|(?P<op><<=|>>=|&\^=|&\^|\.\.\.|:=|<-|&&|\|\||\+\+|--|==|!=|<=|>=|\+=|-=|\*=|/=|%=|&=|\|=|\^=|<<|>>|[-+*/%=<>!&|^~:;,.()\[\]{}])|(?P<end>\Z))",
    re.S,
)
_SQL = re.compile(
    r"\s*(?:(?P<blank>--[^\n]*)|(?P<long>/\*)|(?P<str>[eE]'(?:[^'\\]|''|\\.)*+'|(?:[bBxXnN]|[uU]&)?'(?:[^']|'')*+'|(?P<tag>\$(?:[^\W\d]\w*)?\$).*?(?P=tag))|(?P<name>[^\W\d][\w$]*|\"(?:[^\"]|\"\")++\")|(?P<num>(?:\d[\d_]*\.?\d*|\.\d+)(?:[eE][+-]?\d+)?|\$\d+)|(?P<op>::|:=|=>|\.\.|->>|->|#>>|#>|<=|>=|<>|!=|!~~?\*?|~~?\*?|@>|<@|\|\||\|/|&&|@@|<<|>>|[-+*/%^=<>&|#!?~@:;,.()\[\]{}])|(?P<end>\Z))",
    re.S,
)
_ENDS_LINE = frozenset(") ] } ++ --".split())
_GO_WORDS = frozenset("break continue fallthrough return".split())
_GO_KEYWORDS = frozenset("break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select struct switch type var".split())


_BLOCK_END = re.compile(r'(?:[^\\"]|\\.|"(?!""))*"""', re.S)
_COMMENT_MARK = re.compile(r"/\*|\*/")
_TAG = re.compile(r"\$(?:[^\W\d]\w*)?\$")
_SQL_ENDS = {"'": re.compile(r"(?:[^']|'')*+'"), "e'": re.compile(r"(?:[^'\\]|''|\\.)*+'", re.S), '"': re.compile(r'(?:[^"]|"")*+"')}
_BLANKS = re.compile(r"\s*")
_SQL_OPEN = re.compile(r"(?:([eE])|[bBxXnN]|[uU]&)?'|\"")


def java(out: Tokens, text: str, state: str = "") -> str:
    at, match = 0, _JAVA.match
    if state == "/*":
        at = text.find("*/") + 2
        if at < 2:
            return state
    elif state:
        m = _BLOCK_END.match(text)
        if not m:
            return state
        at = m.end()
    while at < len(text):
        m = match(text, at)
        if not m:
            raise Broken(f"character {text[at]!r}")
        at, group = m.end(), m.lastgroup
        if group == "end":
            break
        if group != "blank":
            token = m[group]
            if token == "/" and text.startswith("*", at):
                return "/*"
            if token == '""' and text.startswith('"', at):
                out.add(STRING, '"""', False)
                return '"""'
            if group == "num" and at < len(text) and (text[at].isalnum() or text[at] == "_"):
                raise Broken("number")
            out.add(_KINDS[group], token, False)
    return ""


def _line_end(out: Tokens) -> None:
    """The semicolon that a line's end stands for in Go."""
    kind, texts = out.kind, out.text
    if texts and (kind[-1] in (NUMBER, STRING) or (kind[-1] == NAME and (texts[-1] not in _GO_KEYWORDS or texts[-1] in _GO_WORDS)) or texts[-1] in _ENDS_LINE):
        out.add(OP, ";", False)


def go(out: Tokens, text: str, state: str = "") -> str:
    """Go, with the semicolons that line ends stand for."""
    at, match = 0, _GO.match
    if state:
        at = text.find("*/" if state == "/*" else "`") + len(state)
        if at < len(state):
            return state
    while at < len(text):
        m = match(text, at)
        if not m:
            if text[at:].lstrip(" \t\r")[:1] == "`":
                out.add(STRING, "`", False)
                return "`"
            raise Broken(f"character {text[at]!r}")
        at, group = m.end(), m.lastgroup
        if group == "line":
            _line_end(out)
        elif group == "end":
            break
        elif group == "long":
            if "\n" in m["long"]:
                _line_end(out)
        else:
            token = m[group]
            if token == "/" and text.startswith("*", at):
                _line_end(out)  # a comment that reaches into the next chunk holds a line's end
                return "/*"
            if group == "num" and at < len(text) and (text[at].isalnum() or text[at] == "_"):
                raise Broken("number")
            out.add(_KINDS[group], token, False)
    return ""


def sql(out: Tokens, text: str, state: str = "") -> str:
    """PostgreSQL, keywords in upper case; block comments nest, and only an E string has escapes."""
    at, match, depth = 0, _SQL.match, 0
    if state.startswith("/*"):
        depth = int(state[2:])
    elif state.startswith("$"):
        at = text.find(state) + len(state)
        if at < len(state):
            return state
    elif state:
        m = _SQL_ENDS[state].match(text)
        if not m:
            return state
        at = m.end()
    while at < len(text):
        while depth:
            m = _COMMENT_MARK.search(text, at)
            if not m:
                return f"/*{depth}"
            depth += 1 if m.group() == "/*" else -1
            at = m.end()
        m = match(text, at)
        name = m and m.lastgroup == "name"
        if not m or name and (m["name"][0] == '"' or text[m.end() : m.end() + 1] in ("'", "&")):
            # a string or tag may be open that a later chunk closes
            first = m.start("name") if name else _BLANKS.match(text, at).end()
            o = _SQL_OPEN.match(text, first)
            if o and (m is None or o.end() > m.end()):
                out.add(STRING if o.group()[-1] == "'" else NAME, o.group(), False)
                return "e'" if o[1] else o.group()[-1]
            if not m:
                if t := _TAG.match(text, first):
                    out.add(STRING, t.group(), False)
                    return t.group()
                raise Broken(f"character {text[first]!r}")
        at, group = m.end(), m.lastgroup
        if group == "end":
            break
        if group == "long":
            depth = 1
        elif group != "blank":
            token = m["str" if group == "tag" else group]
            if group == "num" and at < len(text) and (text[at].isalpha() or text[at] == "_"):
                raise Broken("number")
            out.add(_KINDS["str" if group == "tag" else group], token.upper() if group == "name" and token[0] != '"' else token, False)
    return f"/*{depth}" if depth else ""


LEXERS = {"javascript": javascript, "java": java, "go": go, "sql": sql}
