"""Local grammars of balanced statements: JavaScript modules, TypeScript, Java, Go and PostgreSQL.

Each reads tokens whose brackets are already matched, so a construct knows where it ends before it is read. Operators
are taken without precedence: that decides what an expression means, not whether it is one.
"""

from __future__ import annotations

from .lexing import END, NAME, NUMBER, OP, STRING, Broken, Tokens, read


class Reader:
    """A place in a token list."""

    def __init__(self, tokens: Tokens) -> None:
        self.kind, self.text, self.broke, self.match = tokens.kind, tokens.text, tokens.broke, tokens.match
        self.i = 0

    def op(self, t: str) -> bool:
        """Take the operator t if it comes next."""
        if self.text[self.i] == t and self.kind[self.i] == OP:
            self.i += 1
            return True
        return False

    def is_op(self, *ts: str) -> bool:
        return self.kind[self.i] == OP and self.text[self.i] in ts

    def word(self, *ts: str) -> bool:
        if self.kind[self.i] == NAME and self.text[self.i] in ts:
            self.i += 1
            return True
        return False

    def is_word(self, *ts: str) -> bool:
        return self.kind[self.i] == NAME and self.text[self.i] in ts

    def need(self, t: str) -> None:
        if self.text[self.i] != t or self.kind[self.i] not in (OP, NAME):
            raise Broken(f"expected {t}, not {self.text[self.i]!r}")
        self.i += 1

    def name(self, banned: frozenset[str] = frozenset()) -> str:
        if self.kind[self.i] != NAME or self.text[self.i] in banned:
            raise Broken(f"expected a name, not {self.text[self.i]!r}")
        self.i += 1
        return self.text[self.i - 1]

    def tries(self, f, *args) -> bool:
        """f, or nothing if that fails."""
        i = self.i
        try:
            f(*args)
            return True
        except Broken:
            self.i = i
            return False

    def fail(self):
        raise Broken(f"unexpected {self.text[self.i]!r}")


# -- JavaScript and TypeScript -----------------------------------------------------------------------------------------

_JS_WORDS = frozenset("break case catch class const continue debugger default delete do else enum export extends false finally for function if import in instanceof new null return super switch this throw true try typeof var void while with".split())
_JS_BINARY = frozenset("* / % + - ** << >> >>> < > <= >= == != === !== & | ^ && || ?? = += -= *= /= %= **= <<= >>= >>>= &= |= ^= &&= ||= ??=".split())
_JS_ASSIGN = frozenset("= += -= *= /= %= **= <<= >>= >>>= &= |= ^= &&= ||= ??=".split())
_MODIFIERS = frozenset("public private protected readonly static abstract override declare async accessor get set".split())


class Script(Reader):
    def __init__(self, tokens: Tokens, typed: bool) -> None:
        super().__init__(tokens)
        self.typed = typed

    def module(self) -> None:
        while self.kind[self.i] != END:
            self.statement(True)

    def end(self) -> None:
        """The end of a statement: a semicolon, or a line break or brace in its place."""
        if not self.op(";") and not self.is_op("}") and self.kind[self.i] != END and not self.broke[self.i]:
            self.fail()

    def block(self) -> None:
        self.need("{")
        while not self.op("}"):
            self.statement()

    def statement(self, top: bool = False) -> None:
        k, t = self.kind[self.i], self.text[self.i]
        if k == OP:
            if t == "{":
                return self.block()
            if t == ";":
                self.i += 1
                return None
            if t == "@":
                self.decorators()
                return self.statement(top)
        elif k == NAME:
            f = getattr(self, "s_" + t, None)
            if f and not (t in ("async", "let", "type", "interface", "namespace", "declare", "abstract", "enum", "module") and not self.declares(t)):
                return f(top)
            if self.text[self.i + 1] == ":" and self.kind[self.i + 1] == OP and t not in _JS_WORDS:
                self.i += 2
                return self.statement()
        self.expression()
        self.end()
        return None

    def declares(self, t: str) -> bool:
        """Whether a word that is no keyword everywhere begins a declaration here."""
        k, n = self.kind[self.i + 1], self.text[self.i + 1]
        if t == "let":
            return k == NAME or n in ("[", "{")
        if t == "async":
            return n == "function" and not self.broke[self.i + 1]
        if not self.typed or self.broke[self.i + 1]:
            return False
        return k == NAME or (t in ("module", "namespace", "declare") and (k == STRING or n == "{"))

    def decorators(self) -> None:
        while self.op("@"):
            if self.is_op("("):
                self.parens()
            else:
                self.name()
                while self.op("."):
                    self.name()
                if self.is_op("("):
                    self.arguments()

    def parens(self) -> None:
        self.need("(")
        self.expression()
        self.need(")")

    def variables(self, ends: bool = True, loop: bool = False) -> None:
        self.i += 1
        while True:
            pattern = self.is_op("[", "{")
            self.binding()
            if self.typed:
                self.op("!")
                if self.op(":"):
                    self.type()
            if self.op("="):
                self.assignment(not loop)
            elif pattern and not loop:
                self.fail()
            if not self.op(","):
                break
        if ends:
            self.end()

    def s_const(self, top):
        if self.typed and self.text[self.i + 1] == "enum":
            self.i += 1
            return self.s_enum(top)
        return self.variables()

    def s_let(self, top):
        self.variables()

    s_var = s_let

    def binding(self) -> None:
        if self.is_op("["):
            close = self.match[self.i]
            self.i += 1
            while self.i < close:
                if self.op(","):
                    continue
                self.op("...")
                self.binding()
                if self.op("="):
                    self.assignment()
                if self.i < close:
                    self.need(",")
            self.need("]")
        elif self.op("{"):
            while not self.op("}"):
                if self.op("..."):
                    self.name()
                else:
                    plain = self.kind[self.i] == NAME
                    self.key()
                    if self.op(":"):
                        self.binding()
                    elif not plain:
                        self.fail()
                    if self.op("="):
                        self.assignment()
                if not self.is_op("}"):
                    self.need(",")
        else:
            self.name(_JS_WORDS - {"this"} if self.typed else _JS_WORDS)

    def parameters(self) -> None:
        self.need("(")
        while not self.op(")"):
            self.decorators()
            if self.typed:
                while self.is_word("public", "private", "protected", "readonly", "override") and self.kind[self.i + 1] == NAME:
                    self.i += 1
            self.op("...")
            self.binding()
            if self.typed:
                self.op("?")
                if self.op(":"):
                    self.type()
            if self.op("="):
                self.assignment()
            if not self.is_op(")"):
                self.need(",")

    def signature(self) -> None:
        if self.typed and self.is_op("<"):
            self.type_parameters()
        self.parameters()
        if self.typed and self.op(":"):
            self.return_type()

    def return_type(self) -> None:
        if self.is_word("asserts") and self.kind[self.i + 1] == NAME and not self.broke[self.i + 1]:
            self.i += 1
        self.type()
        if self.word("is"):
            self.type()

    def s_function(self, top=False, expression=False):
        self.i += 1
        self.op("*")
        if self.kind[self.i] == NAME:
            self.name(_JS_WORDS)
        elif not expression:
            self.fail()
        self.signature()
        if self.typed and not expression and not self.is_op("{"):
            return self.end()
        return self.block()

    def s_async(self, top):
        self.i += 1
        self.s_function(top)

    def s_class(self, top=False, expression=False):
        self.need("class")
        if self.kind[self.i] == NAME and not self.is_word("extends", "implements"):
            self.name(_JS_WORDS)
        elif not expression:
            self.fail()
        if self.typed and self.is_op("<"):
            self.type_parameters()
        if self.word("extends"):
            self.unary()
            if self.typed and self.is_op("<"):
                self.type_arguments()
        if self.typed and self.word("implements"):
            self.type()
            while self.op(","):
                self.type()
        self.need("{")
        while not self.op("}"):
            self.member()

    def member(self) -> None:
        if self.op(";"):
            return
        self.decorators()
        if self.is_word("static") and self.text[self.i + 1] == "{":
            self.i += 1
            return self.block()
        while self.is_word(*_MODIFIERS) and not (self.kind[self.i + 1] == OP and self.text[self.i + 1] in ("(", "=", ";", "}", ":", "?", "!", "<", ",")):
            if not self.typed and self.text[self.i] not in ("static", "async", "get", "set", "accessor"):
                self.fail()
            if self.broke[self.i + 1] and self.text[self.i] not in ("static", "get", "set"):
                break
            self.i += 1
        self.op("*")
        if self.typed and self.is_op("[") and self.text[self.i + 2] == ":":  # index signature
            self.i += 1
            self.name()
            self.need(":")
            self.type()
            self.need("]")
        else:
            self.key()
        if self.typed:
            self.op("?") or self.op("!")
        if self.is_op("(") or (self.typed and self.is_op("<")):
            self.signature()
            if self.is_op("{"):
                return self.block()
            if not self.typed:
                self.fail()
            return self.end()
        if self.typed and self.op(":"):
            self.type()
        if self.op("="):
            self.assignment()
        return self.end()

    def key(self) -> None:
        """The name of a property."""
        if self.op("["):
            self.assignment()
            self.need("]")
        elif self.kind[self.i] in (NAME, NUMBER) or (self.kind[self.i] == STRING and self.text[self.i][0] in "\"'"):
            self.i += 1
        else:
            self.fail()

    def s_if(self, top):
        self.i += 1
        self.parens()
        self.statement()
        if self.word("else"):
            self.statement()

    def s_for(self, top):
        self.i += 1
        self.word("await")
        close = self.match.get(self.i, -1)
        self.need("(")
        if self.is_word("var", "const") or (self.is_word("let") and self.declares("let")):
            self.variables(False, True)
        elif not self.is_op(";"):
            self.expression(False)
        if self.word("of"):
            self.assignment()
        elif self.word("in"):
            self.expression()
        else:
            self.need(";")
            if not self.is_op(";"):
                self.expression()
            self.need(";")
            if self.i < close:
                self.expression()
        self.need(")")
        self.statement()

    def s_while(self, top):
        self.i += 1
        self.parens()
        self.statement()

    s_with = s_while

    def s_do(self, top):
        self.i += 1
        self.statement()
        self.need("while")
        self.parens()
        self.op(";")

    def s_return(self, top):
        if top:
            self.fail()  # a module has no caller
        self.i += 1
        if not self.is_op(";", "}") and not self.broke[self.i]:
            self.expression()
        self.end()

    def s_throw(self, top):
        self.i += 1
        if self.broke[self.i]:
            self.fail()
        self.expression()
        self.end()

    def s_break(self, top):
        self.i += 1
        if self.kind[self.i] == NAME and not self.broke[self.i]:
            self.i += 1
        self.end()

    s_continue = s_break

    def s_debugger(self, top):
        self.i += 1
        self.end()

    def s_try(self, top):
        self.i += 1
        self.block()
        if self.word("catch"):
            if self.op("("):
                self.binding()
                if self.typed and self.op(":"):
                    self.type()
                self.need(")")
            self.block()
            if self.word("finally"):
                self.block()
        else:
            self.need("finally")
            self.block()

    def s_switch(self, top):
        self.i += 1
        self.parens()
        self.need("{")
        while not self.op("}"):
            if not self.word("default"):
                self.need("case")
                self.expression()
            self.need(":")
            while not self.is_op("}") and not self.is_word("case", "default"):
                self.statement()

    def s_import(self, top):
        if self.text[self.i + 1] in ("(", "."):
            self.expression()
            return self.end()
        if not top:
            self.fail()
        self.i += 1
        if self.kind[self.i] == STRING:
            self.i += 1
        else:
            if self.typed and self.is_word("type") and self.text[self.i + 1] not in ("from", ","):
                self.i += 1
            if self.kind[self.i] == NAME:
                self.name(_JS_WORDS)
                if self.typed and self.op("="):
                    self.expression()
                    return self.end()
                if not self.is_word("from"):
                    self.need(",")
            if self.op("*"):
                self.need("as")
                self.name(_JS_WORDS)
            elif self.is_op("{"):
                self.names()
            self.need("from")
            self.string()
        if self.word("with", "assert"):
            self.unary()
        return self.end()

    def string(self) -> None:
        if self.kind[self.i] != STRING or self.text[self.i][0] not in "\"'":
            self.fail()
        self.i += 1

    def names(self) -> None:
        """{ a, b as c, default as d }"""
        self.need("{")
        while not self.op("}"):
            if self.kind[self.i] not in (NAME, STRING):
                self.fail()
            self.i += 1
            if self.typed and self.text[self.i - 1] == "type" and self.kind[self.i] == NAME and not self.is_word("as"):
                self.i += 1
            if self.word("as"):
                if self.kind[self.i] not in (NAME, STRING):
                    self.fail()
                self.i += 1
            if not self.is_op("}"):
                self.need(",")

    def s_export(self, top):
        if not top:
            self.fail()
        self.i += 1
        if self.word("default"):
            if self.is_word("function") or (self.is_word("async") and self.text[self.i + 1] == "function"):
                self.word("async")
                return self.s_function(top, True)
            if self.is_word("class"):
                return self.s_class(top, True)
            if self.typed and self.is_word("abstract", "interface"):
                return self.statement(top)
            self.assignment()
            return self.end()
        if self.typed and self.is_word("type") and self.text[self.i + 1] in ("{", "*"):
            self.i += 1
        if self.op("*"):
            if self.word("as"):
                self.i += 1
            self.need("from")
            self.string()
            return self.end()
        if self.is_op("{"):
            self.names()
            if self.word("from"):
                self.string()
            return self.end()
        if self.typed and self.op("="):
            self.expression()
            return self.end()
        if self.is_op("@"):
            self.decorators()
        if self.is_word("const", "let", "var", "function", "class", "async") or (self.typed and self.is_word("type", "interface", "enum", "namespace", "declare", "abstract", "module", "import")):
            return self.statement(top)
        return self.fail()

    # declarations of TypeScript

    def s_type(self, top):
        self.i += 1
        self.name()
        if self.is_op("<"):
            self.type_parameters()
        self.need("=")
        self.type()
        self.end()

    def s_interface(self, top):
        self.i += 1
        self.name()
        if self.is_op("<"):
            self.type_parameters()
        if self.word("extends"):
            self.type()
            while self.op(","):
                self.type()
        self.members()

    def s_enum(self, top):
        self.i += 1
        if not self.typed:
            self.fail()
        self.name()
        self.need("{")
        while not self.op("}"):
            self.key()
            if self.op("="):
                self.assignment()
            if not self.is_op("}"):
                self.need(",")

    def s_namespace(self, top):
        self.i += 1
        if self.kind[self.i] == STRING:
            self.i += 1
        elif self.kind[self.i] == NAME:
            self.name()
            while self.op("."):
                self.name()
        if not self.is_op("{"):
            return self.end()
        self.need("{")
        while not self.op("}"):
            self.statement(True)
        return None

    s_module = s_namespace

    def s_declare(self, top):
        self.i += 1
        if self.word("global"):
            return self.block()
        if self.is_word("const", "let", "var"):
            self.i += 1
            while True:
                self.binding()
                if self.op(":"):
                    self.type()
                if self.op("="):
                    self.assignment()
                if not self.op(","):
                    return self.end()
        return self.statement(top)

    def s_abstract(self, top):
        self.i += 1
        self.s_class(top)

    # types

    def type_parameters(self) -> None:
        self.need("<")
        while True:
            self.word("const")
            if self.is_word("in", "out") and self.kind[self.i + 1] == NAME:
                self.i += 1
            self.name()
            if self.word("extends"):
                self.type()
            if self.op("="):
                self.type()
            if not self.op(","):
                break
            if self.is_op(">"):
                break
        self.close_angle()

    def type_arguments(self) -> None:
        self.need("<")
        self.type()
        while self.op(","):
            self.type()
        self.close_angle()

    def close_angle(self) -> None:
        if self.op(">"):
            return
        t = self.text[self.i]
        if self.kind[self.i] == OP and t in (">=", ">>=", ">>>="):
            self.text[self.i] = t[1:]
            return
        self.fail()

    def type(self) -> None:
        self.op("|") or self.op("&")
        self.type_operand()
        while True:
            if self.is_op("|", "&"):
                self.i += 1
                self.type_operand()
            elif self.is_word("extends") and not self.broke[self.i]:
                i = self.i
                self.i += 1
                self.type_operand()
                while self.is_op("|", "&"):
                    self.i += 1
                    self.type_operand()
                if not self.op("?"):
                    self.i = i
                    return
                self.type()
                self.need(":")
                self.type()
            else:
                return

    def type_operand(self) -> None:
        while self.is_word("keyof", "readonly", "unique", "infer", "abstract", "asserts") and (self.kind[self.i + 1] in (NAME, STRING) or self.text[self.i + 1] in ("{", "[", "(")) and not self.is_word("is", "extends"):
            self.i += 1
        k, t = self.kind[self.i], self.text[self.i]
        if k == OP and t == "(":
            close = self.match[self.i]
            if self.text[close + 1] == "=>" and self.kind[close + 1] == OP:
                self.parameters()
                self.need("=>")
                return self.return_type()
            self.i += 1
            self.type()
            self.need(")")
        elif k == OP and t == "<":
            self.type_parameters()
            self.parameters()
            self.need("=>")
            return self.return_type()
        elif k == OP and t == "[":
            self.i += 1
            while not self.op("]"):
                self.op("...")
                if self.kind[self.i] == NAME and (self.text[self.i + 1] == ":" or (self.text[self.i + 1] == "?" and self.text[self.i + 2] == ":")):
                    self.i += 1
                    self.op("?")
                    self.need(":")
                self.type()
                self.op("?")
                if not self.is_op("]"):
                    self.need(",")
        elif k == OP and t == "{":
            self.members()
        elif k == OP and t == "-" and self.kind[self.i + 1] == NUMBER:
            self.i += 2
        elif k in (STRING, NUMBER):
            self.template() if t == "`" else self.step()
        elif k == NAME and t in ("typeof", "import"):
            self.i += 1
            if t == "import" or self.is_word("import"):
                self.word("import")
                self.need("(")
                self.string()
                self.need(")")
            else:
                self.name()
            while self.op("."):
                self.name()
            if self.is_op("<") and not self.broke[self.i]:
                self.type_arguments()
        elif k == NAME and t == "new":
            self.i += 1
            if self.is_op("<"):
                self.type_parameters()
            self.parameters()
            self.need("=>")
            return self.type()
        elif k == NAME:
            self.name(_JS_WORDS - {"void", "null", "this", "true", "false"})
            while self.op("."):
                self.name()
            if self.is_op("<") and not self.broke[self.i]:
                self.type_arguments()
        else:
            self.fail()
        while self.is_op("[") and not self.broke[self.i]:
            self.i += 1
            if not self.op("]"):
                self.type()
                self.need("]")
        return None

    def step(self) -> None:
        self.i += 1

    def members(self) -> None:
        """The body of an interface or an object type, mapped types too."""
        self.need("{")
        while not self.op("}"):
            if self.is_op("+", "-"):
                self.i += 1
            while self.is_word("readonly", "get", "set", "static") and self.text[self.i + 1] not in (":", "?", "(", ",", ";", "}", "<"):
                self.i += 1
            if self.is_op("(", "<"):
                self.signature()
            elif self.is_word("new") and self.text[self.i + 1] in ("(", "<"):
                self.i += 1
                self.signature()
            elif self.is_op("[") and (self.text[self.i + 2] in (":", "in")):
                self.i += 1
                self.name()
                if self.word("in"):
                    self.type()
                    if self.word("as"):
                        self.type()
                else:
                    self.need(":")
                    self.type()
                self.need("]")
                if self.is_op("+", "-"):
                    self.i += 1
                self.op("?")
                if self.op(":"):
                    self.type()
            else:
                self.key()
                self.op("?")
                if self.is_op("(", "<"):
                    self.signature()
                elif self.op(":"):
                    self.type()
            if not self.op(",") and not self.op(";") and not self.is_op("}") and not self.broke[self.i]:
                self.fail()

    # expressions

    def expression(self, use_in: bool = True) -> None:
        self.assignment(use_in)
        while self.op(","):
            self.assignment(use_in)

    def assignment(self, use_in: bool = True) -> None:
        if self.arrow():
            return
        self.operand()
        while True:
            k, t = self.kind[self.i], self.text[self.i]
            if k == OP:
                if t == ">" and self.kind[self.i + 1] == OP and self.text[self.i + 1] in (">", ">=", ">>="):
                    while self.is_op(">", ">=", ">>="):
                        self.i += 1
                        if self.text[self.i - 1] != ">":
                            break
                elif t in _JS_BINARY:
                    self.i += 1
                elif t == "?":
                    self.i += 1
                    self.assignment()
                    self.need(":")
                    self.assignment(use_in)
                    return
                else:
                    return
                if t in _JS_ASSIGN:
                    return self.assignment(use_in)
                if self.arrow():
                    return self.fail()
                self.operand()
            elif k == NAME and (t == "instanceof" or (t == "in" and use_in)):
                self.i += 1
                self.operand()
            elif k == NAME and self.typed and t in ("as", "satisfies") and not self.broke[self.i]:
                self.i += 1
                if not self.word("const"):
                    self.type()
            else:
                return

    def arrow(self) -> bool:
        """An arrow function, if one begins here."""
        i = self.i
        if self.is_word("async") and not self.broke[i + 1] and (self.kind[i + 1] == NAME or self.text[i + 1] in ("(", "<")):
            if self.kind[i + 1] == NAME and self.text[i + 2] != "=>":
                return False
            i += 1
        if self.kind[i] == NAME and self.text[i + 1] == "=>" and self.kind[i + 1] == OP and self.text[i] not in _JS_WORDS:
            self.i = i + 2
        elif self.kind[i] == OP and self.text[i] == "(" and (self.text[self.match[i] + 1] == "=>" or (self.typed and self.text[self.match[i] + 1] == ":")):
            before, self.i = self.i, i
            if self.text[self.match[i] + 1] == "=>":
                self.parameters()
            elif not self.tries(self.typed_arrow):
                self.i = before
                return False
            self.need("=>")
        elif self.typed and self.kind[i] == OP and self.text[i] == "<":
            before, self.i = self.i, i
            if not self.tries(self.typed_arrow):
                self.i = before
                return False
            self.need("=>")
        else:
            return False
        self.block() if self.is_op("{") else self.assignment()
        return True

    def typed_arrow(self) -> None:
        self.signature()
        if not self.is_op("=>"):
            self.fail()

    def operand(self) -> None:
        self.unary()

    def unary(self) -> None:
        while True:
            k, t = self.kind[self.i], self.text[self.i]
            if k == OP and t in ("!", "~", "+", "-", "++", "--"):
                self.i += 1
            elif k == NAME and t in ("typeof", "void", "delete"):
                self.i += 1
            elif k == NAME and t == "await" and (self.kind[self.i + 1] != OP or self.text[self.i + 1] in ("(", "[", "{", "!", "`")):
                self.i += 1
            elif k == NAME and t == "yield":
                self.i += 1
                self.op("*")
                if self.broke[self.i] or self.is_op(")", "]", "}", ",", ";", ":") or self.kind[self.i] == END:
                    return
                return self.assignment()
            elif self.typed and k == OP and t == "<":
                if not self.tries(self.type_arguments):
                    self.fail()
            else:
                break
        self.primary()
        self.postfix()

    def primary(self) -> None:
        k, t = self.kind[self.i], self.text[self.i]
        if k == NAME:
            if t == "function":
                return self.s_function(False, True)
            if t == "async" and self.text[self.i + 1] == "function" and not self.broke[self.i + 1]:
                self.i += 1
                return self.s_function(False, True)
            if t == "class":
                return self.s_class(False, True)
            if t == "new":
                self.i += 1
                if self.op("."):
                    self.name()
                    return None
                self.primary()
                while True:
                    if self.op("."):
                        self.name()
                    elif self.op("["):
                        self.expression()
                        self.need("]")
                    else:
                        break
                if self.typed and self.is_op("<"):
                    self.tries(self.type_arguments)
                if self.is_op("("):
                    self.arguments()
                return None
            if t == "import":
                self.i += 1
                if self.is_op("("):
                    return self.arguments()
                self.need(".")
                self.name()
                return None
            if t in _JS_WORDS and t not in ("this", "super", "null", "true", "false"):
                self.fail()
            self.i += 1
        elif k == NUMBER:
            self.i += 1
        elif k == STRING:
            self.template() if t == "`" else self.step()
        elif t == "(":
            self.parens()
        elif t == "[":
            close = self.match[self.i]
            self.i += 1
            while self.i < close:
                if self.op(","):
                    continue
                self.op("...")
                self.assignment()
                if self.i < close:
                    self.need(",")
            self.need("]")
        elif t == "{":
            self.object()
        elif t == "@":
            self.decorators()
            self.s_class(False, True)
        else:
            self.fail()
        return None

    def template(self) -> None:
        self.i += 1
        while self.op("${"):
            self.expression()
            self.need("}")
            if self.text[self.i] != "`+":
                self.fail()
            self.i += 1

    def object(self) -> None:
        self.need("{")
        while not self.op("}"):
            if self.op("..."):
                self.assignment()
            else:
                while self.is_word("get", "set", "async") and self.text[self.i + 1] not in (",", ":", "(", "}", "=", "<"):
                    self.i += 1
                self.op("*")
                plain = self.kind[self.i] == NAME and self.text[self.i] not in _JS_WORDS
                self.key()
                if self.op(":"):
                    self.assignment()
                elif self.is_op("(") or (self.typed and self.is_op("<")):
                    self.signature()
                    self.block()
                elif not plain:
                    self.fail()
                elif self.op("="):
                    self.assignment()
            if not self.is_op("}"):
                self.need(",")

    def arguments(self) -> None:
        self.need("(")
        while not self.op(")"):
            self.op("...")
            self.assignment()
            if not self.is_op(")"):
                self.need(",")

    def postfix(self) -> None:
        while True:
            k, t = self.kind[self.i], self.text[self.i]
            if k == STRING and t == "`":
                self.template()
            elif k != OP:
                return
            elif t == ".":
                self.i += 1
                self.name()
            elif t == "?.":
                self.i += 1
                if not self.is_op("(", "["):
                    self.name()
            elif t == "(":
                self.arguments()
            elif t == "[":
                self.i += 1
                self.expression()
                self.need("]")
            elif t in ("++", "--") and not self.broke[self.i]:
                self.i += 1
            elif self.typed and t == "!" and not self.broke[self.i]:
                self.i += 1
            elif self.typed and t == "<" and self.tries(self.call_types):
                pass
            else:
                return

    def call_types(self) -> None:
        self.type_arguments()
        if not self.is_op("(", ")", ",", ";", "]", "}", ".") and self.text[self.i] != "`" and self.kind[self.i] != END:
            self.fail()


# -- Java --------------------------------------------------------------------------------------------------------------

_JAVA_WORDS = frozenset(
    "abstract assert break case catch class const continue default do else enum extends final finally for goto if implements import instanceof interface native new package private protected public return static strictfp super switch synchronized this throw throws transient try void volatile while true false null boolean byte char short int long float double".split()
)
_PRIMITIVE = frozenset("boolean byte char short int long float double".split())
_JAVA_MODIFIERS = frozenset("public private protected static final abstract native synchronized transient volatile strictfp default sealed".split())
_JAVA_BINARY = frozenset("* / % + - << < > <= >= == != & | ^ && || = += -= *= /= %= <<= >>= >>>= &= |= ^=".split())


class JavaUnit(Reader):
    def unit(self) -> None:
        i = self.i
        self.annotations()
        if self.word("package"):
            self.dotted()
            self.need(";")
        else:
            self.i = i
        while self.op(";") or self.is_word("import"):
            if self.word("import"):
                self.word("static")
                self.name(_JAVA_WORDS)
                while self.op("."):
                    if self.op("*"):
                        break
                    self.name(_JAVA_WORDS)
                self.need(";")
        if self.is_word("module", "open") and self.kind[self.i + 1] == NAME:
            while not self.is_op("{"):
                self.name()
            self.i = self.match[self.i] + 1
        while self.kind[self.i] != END:
            if not self.op(";"):
                self.modifiers()
                if not self.declaration():
                    self.fail()

    def dotted(self) -> None:
        self.name(_JAVA_WORDS)
        while self.op("."):
            self.name(_JAVA_WORDS)

    def annotations(self) -> None:
        while self.is_op("@") and self.text[self.i + 1] != "interface":
            self.i += 1
            self.dotted()
            if self.op("("):
                while not self.op(")"):
                    if self.kind[self.i] == NAME and self.text[self.i + 1] == "=":
                        self.i += 2
                    self.element()
                    if not self.is_op(")"):
                        self.need(",")

    def element(self) -> None:
        if self.is_op("@"):
            self.annotations()
        elif self.is_op("{"):
            self.initializer()
        else:
            self.expression()

    def modifiers(self) -> None:
        while True:
            if self.is_op("@") and self.text[self.i + 1] != "interface":
                self.annotations()
            elif self.is_word(*_JAVA_MODIFIERS) and not (self.text[self.i] == "default" and self.text[self.i + 1] in (":", "->")) and not (self.text[self.i] == "sealed" and self.kind[self.i + 1] != NAME):
                self.i += 1
            elif self.is_word("non") and self.text[self.i + 1] == "-":
                self.i += 3
            else:
                return

    def declaration(self) -> bool:
        """A type's declaration, if one begins here (after its modifiers)."""
        if self.word("class"):
            self.head()
            self.body()
        elif self.word("interface"):
            self.head()
            self.body()
        elif self.is_op("@") and self.text[self.i + 1] == "interface":
            self.i += 2
            self.name(_JAVA_WORDS)
            self.body()
        elif self.word("enum"):
            self.head()
            self.need("{")
            while self.kind[self.i] == NAME or self.is_op("@"):
                self.annotations()
                self.name(_JAVA_WORDS)
                if self.is_op("("):
                    self.arguments()
                if self.is_op("{"):
                    self.body()
                if not self.op(","):
                    break
            if self.op(";"):
                while not self.is_op("}"):
                    self.member()
            self.need("}")
        elif self.is_word("record") and self.kind[self.i + 1] == NAME and self.text[self.i + 2] in ("(", "<"):
            self.i += 1
            self.name(_JAVA_WORDS)
            if self.is_op("<"):
                self.type_parameters()
            self.parameters()
            if self.word("implements"):
                self.types()
            self.body()
        else:
            return False
        return True

    def head(self) -> None:
        self.name(_JAVA_WORDS)
        if self.is_op("<"):
            self.type_parameters()
        for w in ("extends", "implements", "permits"):
            if self.word(w):
                self.types()

    def types(self) -> None:
        self.type()
        while self.op(",") or self.op("&"):
            self.type()

    def body(self) -> None:
        self.need("{")
        while not self.op("}"):
            self.member()

    def member(self) -> None:
        if self.op(";"):
            return
        if self.is_op("{") or (self.is_word("static") and self.text[self.i + 1] == "{"):
            self.word("static")
            return self.block()
        self.modifiers()
        if self.declaration():
            return None
        if self.is_op("<"):
            self.type_parameters()
        if self.kind[self.i] == NAME and self.text[self.i] not in _JAVA_WORDS and self.text[self.i + 1] in ("(", "{"):  # constructor
            self.i += 1
            if self.is_op("("):
                self.parameters()
            if self.word("throws"):
                self.types()
            return self.block()
        if not self.word("void"):
            self.type()
        self.name(_JAVA_WORDS)
        if self.is_op("("):
            self.parameters()
            while self.op("["):
                self.need("]")
            if self.word("throws"):
                self.types()
            if self.word("default"):
                self.element()
            return self.block() if self.is_op("{") else self.need(";")
        self.variables()
        return self.need(";")

    def parameters(self) -> None:
        self.need("(")
        while not self.op(")"):
            self.modifiers()
            self.type()
            self.annotations()
            self.op("...")
            if not self.word("this"):
                self.name(_JAVA_WORDS)
            while self.op("["):
                self.need("]")
            if not self.is_op(")"):
                self.need(",")
                if self.is_op(")"):
                    self.fail()

    def type_parameters(self) -> None:
        self.need("<")
        while True:
            self.annotations()
            self.name(_JAVA_WORDS)
            if self.word("extends"):
                self.types_and()
            if not self.op(","):
                break
        self.close_angle()

    def types_and(self) -> None:
        self.type()
        while self.op("&"):
            self.type()

    def close_angle(self) -> None:
        if not self.op(">"):
            self.fail()

    def type(self) -> None:
        self.annotations()
        if self.op("?"):
            if self.word("extends", "super"):
                self.type()
            return
        if self.is_word(*_PRIMITIVE):
            self.i += 1
        else:
            self.name(_JAVA_WORDS)
            while True:
                if self.is_op("<"):
                    self.i += 1
                    if not self.op(">"):
                        self.type()
                        while self.op(","):
                            self.type()
                        self.close_angle()
                if not (self.is_op(".") and self.kind[self.i + 1] == NAME and self.text[self.i + 1] not in ("class", "this", "super", "new")):
                    break
                self.i += 1
                self.name(_JAVA_WORDS)
        while self.is_op("[") and self.text[self.i + 1] == "]":
            self.i += 2

    def variables(self) -> None:
        """What follows the first name of a variable's declaration."""
        while True:
            while self.op("["):
                self.need("]")
            if self.op("="):
                self.initializer() if self.is_op("{") else self.expression()
            if not self.op(","):
                return
            self.name(_JAVA_WORDS)

    def initializer(self) -> None:
        self.need("{")
        while not self.op("}"):
            self.element()
            if not self.is_op("}"):
                self.need(",")

    def block(self) -> None:
        self.need("{")
        while not self.op("}"):
            self.statement()

    def parens(self) -> None:
        self.need("(")
        self.expression()
        self.need(")")

    def local(self) -> None:
        self.modifiers()
        self.type()
        self.name(_JAVA_WORDS)
        if not self.is_op("=", ";", ",", ":", "["):
            self.fail()

    def statement(self) -> None:
        k, t = self.kind[self.i], self.text[self.i]
        if k == OP and t == "{":
            return self.block()
        if self.op(";"):
            return None
        if k == NAME:
            if t in ("if", "while"):
                self.i += 1
                self.parens()
                self.statement()
                if t == "if" and self.word("else"):
                    self.statement()
                return None
            if t == "for":
                self.i += 1
                self.need("(")
                if self.tries(self.local):
                    if self.op(":"):
                        self.expression()
                        self.need(")")
                        return self.statement()
                    self.variables()
                elif not self.is_op(";"):
                    self.expressions()
                self.need(";")
                if not self.is_op(";"):
                    self.expression()
                self.need(";")
                if not self.is_op(")"):
                    self.expressions()
                self.need(")")
                return self.statement()
            if t == "do":
                self.i += 1
                self.statement()
                self.need("while")
                self.parens()
                return self.need(";")
            if t in ("return", "throw"):
                self.i += 1
                if t == "throw" or not self.is_op(";"):
                    self.expression()
                return self.need(";")
            if t in ("break", "continue"):
                self.i += 1
                if self.kind[self.i] == NAME:
                    self.i += 1
                return self.need(";")
            if t == "yield" and self.text[self.i + 1] not in ("=", ".", "(", "++", "--"):
                self.i += 1
                self.expression()
                return self.need(";")
            if t == "assert":
                self.i += 1
                self.expression()
                if self.op(":"):
                    self.expression()
                return self.need(";")
            if t == "synchronized" and self.text[self.i + 1] == "(":
                self.i += 1
                self.parens()
                return self.block()
            if t == "try":
                self.i += 1
                resources = self.op("(")
                if resources:
                    while not self.op(")"):
                        if self.tries(self.local):
                            self.variables()
                        else:
                            self.expression()
                        if not self.is_op(")"):
                            self.need(";")
                self.block()
                n = 0
                while self.word("catch"):
                    self.need("(")
                    self.modifiers()
                    self.type()
                    while self.op("|"):
                        self.type()
                    self.name(_JAVA_WORDS)
                    self.need(")")
                    self.block()
                    n += 1
                if self.word("finally"):
                    self.block()
                elif not n and not resources:
                    self.fail()
                return None
            if t == "switch":
                self.switch()
                self.op(";")
                return None
            if self.text[self.i + 1] == ":" and t not in _JAVA_WORDS:
                self.i += 2
                return self.statement()
        i = self.i
        self.modifiers()
        if self.declaration():
            return None
        self.i = i
        if self.tries(self.local):
            self.variables()
            return self.need(";")
        start = self.i
        self.expression()
        if self.i == start + 1 and self.kind[start] in (NAME, NUMBER, STRING):
            self.fail()  # a bare name is no statement
        return self.need(";")

    def switch(self) -> None:
        self.need("switch")
        self.parens()
        self.need("{")
        while not self.op("}"):
            if not self.word("default"):
                self.need("case")
                self.label()
                while self.op(","):
                    self.label()
            if self.op("->"):
                if self.is_op("{"):
                    self.block()
                elif self.is_word("throw"):
                    self.statement()
                else:
                    self.expression()
                    self.need(";")
            else:
                self.need(":")
                while not self.is_op("}") and not self.is_word("case") and not (self.is_word("default") and self.text[self.i + 1] in (":", "->")):
                    self.statement()

    def label(self) -> None:
        if self.word("default"):
            return
        if not self.tries(self.pattern):
            self.expression(False)
        if self.word("when"):
            self.expression(False)

    def pattern(self) -> None:
        self.modifiers()
        self.type()
        if self.op("("):
            while not self.op(")"):
                self.pattern()
                if not self.is_op(")"):
                    self.need(",")
            if self.kind[self.i] == NAME and not self.is_word("when"):
                self.i += 1
        else:
            self.name(_JAVA_WORDS)
        if not self.is_op("->", ":", ",", ")", "&&", "||", ";", "?") and not self.is_word("when"):
            self.fail()

    def expressions(self) -> None:
        self.expression()
        while self.op(","):
            self.expression()

    def expression(self, arrows: bool = True) -> None:
        if self.lambda_():
            return
        self.unary()
        while True:
            k, t = self.kind[self.i], self.text[self.i]
            if k == OP and t == ">" and self.is_shift():
                while self.is_op(">", ">="):
                    self.i += 1
                    if self.text[self.i - 1] == ">=":
                        break
                self.unary()
            elif k == OP and t in _JAVA_BINARY:
                self.i += 1
                if t.endswith("=") and t not in ("==", "!=", "<=", ">="):
                    return self.expression()
                self.unary()
            elif k == OP and t == "?":
                self.i += 1
                self.expression()
                self.need(":")
                if not self.lambda_():
                    self.expression()
                return
            elif k == NAME and t == "instanceof":
                self.i += 1
                if not self.tries(self.pattern):
                    self.modifiers()
                    self.type()
            else:
                return

    def is_shift(self) -> bool:
        return self.kind[self.i + 1] == OP and self.text[self.i + 1] in (">", ">=")

    def lambda_(self) -> bool:
        i = self.i
        if self.kind[i] == NAME and self.text[i + 1] == "->" and self.text[i] not in _JAVA_WORDS:
            self.i += 2
        elif self.is_op("(") and self.text[self.match[i] + 1] == "->":
            close = self.match[i]
            j = i + 1
            if all(self.kind[x] == NAME if (x - j) % 2 == 0 else self.text[x] == "," for x in range(j, close)):
                self.i = close + 1
            else:
                self.parameters()
            self.need("->")
        else:
            return False
        self.block() if self.is_op("{") else self.expression()
        return True

    def unary(self) -> None:
        while True:
            if self.is_op("!", "~", "+", "-", "++", "--"):
                self.i += 1
            elif self.is_op("(") and self.tries(self.cast):
                if self.lambda_():
                    return
            else:
                break
        if self.is_word("switch"):
            return self.switch()
        self.primary()
        while True:
            if self.op("."):
                if self.is_op("<"):
                    self.i += 1
                    self.types()
                    self.close_angle()
                if self.word("new"):
                    self.creation()
                elif not self.word("class", "this", "super"):
                    self.name(_JAVA_WORDS)
            elif self.is_op("("):
                self.arguments()
            elif self.op("["):
                if not self.op("]"):
                    self.expression()
                    self.need("]")
            elif self.op("::"):
                if not self.word("new"):
                    self.name(_JAVA_WORDS)
            elif self.is_op("++", "--"):
                self.i += 1
            elif self.is_op("<") and self.tries(self.generic_reference):
                pass
            else:
                return None

    def generic_reference(self) -> None:
        """The type arguments in List<String>::new."""
        self.need("<")
        self.types()
        self.close_angle()
        if not self.is_op("::"):
            self.fail()

    def cast(self) -> None:
        self.need("(")
        primitive = self.is_word(*_PRIMITIVE)
        self.types_and()
        self.need(")")
        k, t = self.kind[self.i], self.text[self.i]
        if not (primitive and t in ("+", "-")) and not (k in (NUMBER, STRING) or (k == NAME and t != "instanceof") or t in ("(", "!", "~")):
            self.fail()

    def primary(self) -> None:
        k, t = self.kind[self.i], self.text[self.i]
        if k in (NUMBER, STRING):
            self.i += 1
        elif k == NAME:
            if t == "new":
                self.i += 1
                return self.creation()
            if t in _PRIMITIVE or t == "void":
                self.i += 1
                while self.op("["):
                    self.need("]")
                if not self.is_op(".", "::"):
                    self.fail()
            elif t in _JAVA_WORDS and t not in ("this", "super", "true", "false", "null"):
                self.fail()
            else:
                self.i += 1
        elif t == "(":
            self.parens()
        else:
            self.fail()
        return None

    def creation(self) -> None:
        self.annotations()
        if self.is_word(*_PRIMITIVE):
            self.i += 1
        else:
            self.name(_JAVA_WORDS)
            while True:
                if self.op("<"):
                    if not self.op(">"):
                        self.types()
                        self.close_angle()
                if not self.op("."):
                    break
                self.name(_JAVA_WORDS)
        if self.is_op("["):
            while self.op("["):
                if not self.op("]"):
                    self.expression()
                    self.need("]")
            if self.is_op("{"):
                self.initializer()
        else:
            self.arguments()
            if self.is_op("{"):
                self.body()

    def arguments(self) -> None:
        self.need("(")
        if self.op(")"):
            return
        self.expressions()
        self.need(")")


# -- Go ----------------------------------------------------------------------------------------------------------------

_GO_WORDS = frozenset("break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select struct switch type var".split())
_GO_BINARY = frozenset("+ - * / % & | ^ << >> &^ == != < <= > >= && ||".split())
_GO_ASSIGN = frozenset("= := += -= *= /= %= &= |= ^= <<= >>= &^=".split())


class GoFile(Reader):
    def file(self) -> None:
        self.need("package")
        self.name(_GO_WORDS)
        self.need(";")
        while self.word("import"):
            self.group(self.import_spec)
            self.need(";")
        while self.kind[self.i] != END:
            if self.word("func"):
                if self.is_op("("):
                    self.parameters()
                self.name(_GO_WORDS)
                if self.is_op("["):
                    self.type_parameters()
                self.signature()
                if self.is_op("{"):
                    self.block()
            elif not self.declaration():
                self.fail()
            self.semicolon()

    def semicolon(self) -> None:
        if not self.op(";") and not self.is_op("}", ")") and self.kind[self.i] != END:
            self.fail()

    def group(self, spec) -> None:
        if self.op("("):
            while not self.op(")"):
                spec()
                self.semicolon()
        else:
            spec()

    def import_spec(self) -> None:
        if not self.op("."):
            if self.kind[self.i] == NAME:
                self.name(_GO_WORDS)
        if self.kind[self.i] != STRING:
            self.fail()
        self.i += 1

    def declaration(self) -> bool:
        if self.word("var"):
            self.group(self.var_spec)
        elif self.word("const"):
            self.group(self.const_spec)
        elif self.word("type"):
            self.group(self.type_spec)
        else:
            return False
        return True

    def var_spec(self) -> None:
        self.names()
        if not self.is_op("="):
            self.type()
        if self.op("="):
            self.expressions()

    def const_spec(self) -> None:
        self.names()
        if not self.is_op("=", ";", ")") and self.kind[self.i] != END:
            self.type()
        if self.op("="):
            self.expressions()

    def type_spec(self) -> None:
        self.name(_GO_WORDS)
        if self.is_op("[") and self.text[self.i + 1] != "]" and self.kind[self.i + 1] == NAME and self.text[self.i + 2] != "]":
            self.type_parameters()
        self.op("=")
        self.type()

    def names(self) -> None:
        self.name(_GO_WORDS)
        while self.op(","):
            self.name(_GO_WORDS)

    def type_parameters(self) -> None:
        self.need("[")
        while not self.op("]"):
            self.names()
            self.constraint()
            if not self.is_op("]"):
                self.need(",")

    def constraint(self) -> None:
        self.op("~")
        self.type()
        while self.op("|"):
            self.op("~")
            self.type()

    def signature(self) -> None:
        self.parameters()
        if self.is_op("("):
            self.parameters()
        elif not self.is_op("{", ";", ")", ",", "]", "}", "=", ":=", ":", ".", "(") and self.kind[self.i] not in (STRING, END):
            self.type()

    def parameters(self) -> None:
        self.need("(")
        while not self.op(")"):
            if self.op("..."):
                self.type()
            else:
                self.type()
                if not self.is_op(",", ")"):
                    self.op("...")
                    self.type()
            if not self.is_op(")"):
                self.need(",")

    def type(self) -> None:
        if self.op("*"):
            return self.type()
        if self.op("("):
            self.type()
            return self.need(")")
        if self.op("["):
            if not self.op("]"):
                if not self.op("..."):
                    self.expression()
                self.need("]")
            return self.type()
        if self.op("<-"):
            self.need("chan")
            return self.type()
        if self.word("map"):
            self.need("[")
            self.type()
            self.need("]")
            return self.type()
        if self.word("chan"):
            self.op("<-")
            return self.type()
        if self.word("func"):
            return self.signature()
        if self.word("struct"):
            self.need("{")
            while not self.op("}"):
                if self.is_op("*", "(") or self.text[self.i + 1] in (".", ";", "}") or self.kind[self.i + 1] == STRING:
                    self.type()
                else:
                    self.names()
                    self.type()
                if self.kind[self.i] == STRING:
                    self.i += 1
                self.semicolon()
            return None
        if self.word("interface"):
            self.need("{")
            while not self.op("}"):
                if self.kind[self.i] == NAME and self.text[self.i + 1] == "(":
                    self.name(_GO_WORDS)
                    self.signature()
                else:
                    self.constraint()
                self.semicolon()
            return None
        self.name(_GO_WORDS)
        if self.op("."):
            self.name(_GO_WORDS)
        if self.is_op("[") and self.text[self.i + 1] != "]":
            self.tries(self.type_arguments)
        return None

    def type_arguments(self) -> None:
        self.need("[")
        self.type()
        while self.op(","):
            self.type()
        self.need("]")

    def block(self) -> None:
        self.need("{")
        self.statements()
        self.need("}")

    def statements(self) -> None:
        while not self.is_op("}") and not self.is_word("case", "default") and self.kind[self.i] != END:
            self.statement()
            self.semicolon()

    def statement(self) -> None:
        k, t = self.kind[self.i], self.text[self.i]
        if k == OP and t == ";":
            return None
        if k == OP and t == "{":
            return self.block()
        if k == NAME:
            if self.declaration():
                return None
            if t in ("return",):
                self.i += 1
                if not self.is_op(";", "}"):
                    self.expressions()
                return None
            if t in ("break", "continue", "goto", "fallthrough"):
                self.i += 1
                if self.kind[self.i] == NAME:
                    self.i += 1
                return None
            if t in ("go", "defer"):
                self.i += 1
                return self.expression()
            if t == "if":
                return self.s_if()
            if t == "for":
                self.i += 1
                if not self.is_op("{"):
                    self.for_clause()
                return self.block()
            if t == "switch":
                self.i += 1
                if not self.is_op("{"):
                    if not self.is_op(";"):
                        self.simple(False)
                    if self.op(";") and not self.is_op("{"):
                        self.simple(False)
                return self.cases()
            if t == "select":
                self.i += 1
                return self.cases()
            if self.text[self.i + 1] == ":" and self.kind[self.i + 1] == OP and t not in _GO_WORDS:
                self.i += 2
                self.op(";")
                return None if self.is_op("}") else self.statement()
        start = self.i
        self.simple(True)
        if self.i == start + 1:
            self.fail()  # a bare name or literal is no statement
        return None

    def s_if(self) -> None:
        self.need("if")
        if not self.is_op(";"):
            self.simple(False)
        if self.op(";"):
            self.simple(False)
        self.block()
        if self.word("else"):
            self.s_if() if self.is_word("if") else self.block()

    def for_clause(self) -> None:
        if self.word("range"):
            return self.expression(False)
        if not self.is_op(";"):
            self.simple(False, True)
        if self.op(";"):
            if not self.is_op(";"):
                self.expression(False)
            self.need(";")
            if not self.is_op("{"):
                self.simple(False)
        return None

    def cases(self) -> None:
        self.need("{")
        while not self.op("}"):
            if not self.word("default"):
                self.need("case")
                self.case_item()
            self.need(":")
            self.statements()

    def case_item(self) -> None:
        self.list_item()
        while self.op(","):
            self.list_item()
        if self.kind[self.i] == OP and self.text[self.i] in _GO_ASSIGN:
            self.i += 1
            self.expressions()
        elif self.op("<-"):
            self.expression()

    def list_item(self) -> None:
        if not self.tries(self.expression) or not self.is_op(",", ":", "=", ":=", "<-"):
            self.type()

    def simple(self, composite: bool, ranged: bool = False) -> None:
        self.expressions(composite)
        if self.kind[self.i] == OP:
            t = self.text[self.i]
            if t in _GO_ASSIGN:
                self.i += 1
                if ranged and self.word("range"):
                    return self.expression(composite)
                self.expressions(composite)
            elif t in ("++", "--"):
                self.i += 1
            elif t == "<-":
                self.i += 1
                self.expression(composite)
        return None

    def expressions(self, composite: bool = True) -> None:
        self.expression(composite)
        while self.op(","):
            self.expression(composite)

    def expression(self, composite: bool = True) -> None:
        self.unary(composite)
        while self.kind[self.i] == OP and self.text[self.i] in _GO_BINARY:
            self.i += 1
            self.unary(composite)

    def unary(self, composite: bool) -> None:
        while self.is_op("+", "-", "!", "^", "*", "&", "<-"):
            self.i += 1
        k, t = self.kind[self.i], self.text[self.i]
        typed = False
        if k in (NUMBER, STRING):
            self.i += 1
        elif k == OP and t == "(":
            self.i += 1
            if not self.tries(self.inner):
                self.type()
                self.need(")")
        elif (k == OP and t == "[") or (k == NAME and t in ("map", "struct", "chan", "interface")):
            self.type()
            typed = composite = True  # only a bare type name is ambiguous before a block
            if not self.is_op("{", "(", ")", ",", "."):
                self.fail()
        elif k == NAME and t == "func":
            self.i += 1
            self.signature()
            if self.is_op("{"):
                self.block()
        elif k == NAME and t not in _GO_WORDS:
            self.i += 1
            typed = True
        else:
            self.fail()
        while self.kind[self.i] == OP:
            t = self.text[self.i]
            if t == ".":
                self.i += 1
                if self.op("("):
                    if not self.word("type"):
                        self.type()
                    self.need(")")
                    typed = False
                else:
                    self.name(_GO_WORDS)
            elif t == "(":
                self.i += 1
                while not self.op(")"):
                    if not self.tries(self.argument):
                        self.type()
                        if not self.is_op(",", ")"):
                            self.fail()
                    if not self.is_op(")"):
                        self.need(",")
                typed = False
            elif t == "[":
                if not self.tries(self.subscript):
                    self.type_arguments()
            elif t == "{" and typed and composite:
                self.literal()
                typed = False
            else:
                return

    def inner(self) -> None:
        self.expression()
        self.need(")")

    def argument(self) -> None:
        self.expression()
        self.op("...")
        if not self.is_op(",", ")"):
            self.fail()

    def subscript(self) -> None:
        self.need("[")
        if not self.is_op(":"):
            self.expression()
        while self.op(":"):
            if not self.is_op(":", "]"):
                self.expression()
        while self.op(","):
            self.type()
        self.need("]")

    def literal(self) -> None:
        self.need("{")
        while not self.op("}"):
            self.literal() if self.is_op("{") else self.expression()
            if self.op(":"):
                self.literal() if self.is_op("{") else self.expression()
            if not self.is_op("}"):
                self.need(",")


# -- PostgreSQL ----------------------------------------------------------------------------------------------------------

#: Words that can't be names of columns or tables.
_SQL_WORDS = frozenset(
    "ALL ANALYSE ANALYZE AND ANY ARRAY AS ASC ASYMMETRIC BOTH CASE CAST CHECK COLLATE COLUMN CONSTRAINT CREATE DEFAULT DEFERRABLE DESC DISTINCT DO ELSE END EXCEPT FALSE FETCH FOR FOREIGN FROM GRANT GROUP HAVING IN INITIALLY INTERSECT INTO LATERAL LEADING LIMIT NOT NULL OFFSET ON ONLY OR ORDER PLACING PRIMARY REFERENCES RETURNING SELECT SYMMETRIC TABLE THEN TO TRAILING TRUE UNION UNIQUE USER USING VARIADIC WHEN WHERE WINDOW WITH "
    "CROSS FULL INNER JOIN LEFT NATURAL RIGHT OUTER IS ISNULL NOTNULL LIKE ILIKE SIMILAR BETWEEN".split()
)
_SQL_BINARY = frozenset("+ - * / % ^ = < > <= >= <> != || | & # << >> ~ ~* !~ !~* ~~ !~~ ~~* !~~* -> ->> #> #>> @> <@ && @@ ? := =>".split())
_CLAUSES = ("FROM", "WHERE", "GROUP", "HAVING", "WINDOW", "ORDER", "LIMIT", "OFFSET", "FETCH", "FOR", "UNION", "INTERSECT", "EXCEPT", "RETURNING", "ON", "INTO", "SET")


class SqlScript(Reader):
    def script(self) -> None:
        while self.kind[self.i] != END:
            if self.op(";"):
                continue
            self.statement()
            if self.kind[self.i] != END:
                self.need(";")

    def statement(self) -> None:
        t = self.text[self.i] if self.kind[self.i] == NAME else ""
        if self.is_op("(") or t in ("SELECT", "VALUES", "WITH", "TABLE"):
            self.query()
        elif t == "INSERT":
            self.insert()
        elif t == "UPDATE":
            self.update()
        elif t == "DELETE":
            self.delete()
        elif t == "CREATE":
            self.create()
        elif t == "ALTER":
            self.alter()
        elif t == "DROP":
            self.i += 1
            while self.kind[self.i] == NAME and not self.is_word("IF") and self.kind[self.i + 1] == NAME and self.text[self.i + 1] not in ("CASCADE", "RESTRICT"):
                self.i += 1
            if self.word("IF"):
                self.need("EXISTS")
            self.names()
            if self.is_op("("):
                self.skip()
            if self.word("ON"):
                self.table_name()
            self.word("CASCADE", "RESTRICT")
        elif t == "TRUNCATE":
            self.i += 1
            self.word("TABLE")
            self.word("ONLY")
            self.names()
            self.options()
        elif t in ("BEGIN", "COMMIT", "ROLLBACK", "START", "END", "ABORT", "SAVEPOINT", "RELEASE", "ANALYZE", "VACUUM", "REINDEX", "CLUSTER", "CHECKPOINT", "DISCARD", "LISTEN", "NOTIFY", "UNLISTEN", "LOCK", "SHOW", "RESET", "DEALLOCATE", "CLOSE", "FETCH", "MOVE", "REFRESH", "CALL", "LOAD", "SECURITY"):
            self.i += 1
            self.options()
        elif t in ("GRANT", "REVOKE"):
            self.i += 1
            if not any(x in ("TO", "FROM") for x in self.rest()):
                self.fail()
            self.options()
        elif t == "SET":
            self.i += 1
            self.word("LOCAL", "SESSION")
            if not self.word("TRANSACTION", "CONSTRAINTS", "ROLE", "NAMES", "AUTHORIZATION", "TIME"):
                self.table_name()
                if not (self.op("=") or self.word("TO")):
                    self.fail()
            self.value_list()
        elif t == "COMMENT":
            self.i += 1
            self.need("ON")
            while not self.is_word("IS") and self.kind[self.i] != END and not self.is_op(";"):
                self.skip()
            self.need("IS")
            if not self.word("NULL"):
                self.string()
        elif t == "DO":
            self.i += 1
            if self.word("LANGUAGE"):
                self.i += 1
            self.string()
            if self.word("LANGUAGE"):
                self.i += 1
        elif t == "MERGE":
            self.merge()
        elif t in ("COPY", "EXPLAIN", "PREPARE", "EXECUTE", "DECLARE", "IMPORT", "REASSIGN"):
            self.i += 1
            if t == "EXPLAIN":
                if self.is_op("("):
                    self.skip()
                self.word("ANALYZE")
                self.word("VERBOSE")
                return self.statement()
            if self.kind[self.i] == END or self.is_op(";"):
                self.fail()
            {"COPY": self.copy, "PREPARE": self.prepare, "EXECUTE": self.execute, "DECLARE": self.declare, "IMPORT": self.foreign_schema, "REASSIGN": self.reassign}[t]()
        else:
            self.fail()
        return None

    def copy(self) -> None:
        if self.op("("):
            self.statement()
            self.need(")")
            self.need("TO")
        else:
            self.word("BINARY", "INTO")
            self.table_name()
            if self.is_op("("):
                self.columns()
            if not self.word("TO", "FROM"):
                self.fail()
        self.some_options("WHERE")
        if self.word("WHERE"):
            self.expression()

    def prepare(self) -> None:
        if self.word("TRANSACTION"):
            return self.string()
        self.ident()
        if self.word("FROM"):
            return self.some_options()
        if self.is_op("("):
            self.skip()
        self.need("AS")
        return self.statement()

    def execute(self) -> None:
        self.ident()
        if self.op("("):
            self.items()
            self.need(")")
        self.options()

    def declare(self) -> None:
        if "CURSOR" not in self.rest():
            return self.options()
        self.ident()
        while self.word("BINARY", "INSENSITIVE", "ASENSITIVE", "NO", "SCROLL"):
            pass
        self.need("CURSOR")
        if self.word("WITH", "WITHOUT"):
            self.need("HOLD")
        self.need("FOR")
        return self.query()

    def foreign_schema(self) -> None:
        self.need("FOREIGN")
        self.need("SCHEMA")
        self.name()
        if self.word("LIMIT"):
            self.need("TO")
            self.skip()
        elif self.word("EXCEPT"):
            self.skip()
        self.need("FROM")
        self.need("SERVER")
        self.name()
        self.need("INTO")
        self.name()
        if self.word("OPTIONS"):
            self.skip()

    def reassign(self) -> None:
        self.need("OWNED")
        self.need("BY")
        self.role_names()
        self.need("TO")
        self.role_names()

    def role_names(self) -> None:
        self.name()
        while self.op(","):
            self.name()

    def some_options(self, *stop: str) -> None:
        if self.kind[self.i] == END or self.is_op(";"):
            self.fail()
        self.options(*stop)

    def merge(self) -> None:
        self.i += 1
        self.word("INTO")
        self.word("ONLY")
        self.table_name()
        self.op("*")
        self.alias()
        self.need("USING")
        self.source()
        self.need("ON")
        self.expression()
        self.need("WHEN")
        while True:
            self.word("NOT")
            self.need("MATCHED")
            if self.word("BY") and not self.word("SOURCE", "TARGET"):
                self.fail()
            if self.word("AND"):
                self.expression()
            self.need("THEN")
            self.merge_action()
            if not self.word("WHEN"):
                break
        self.returning()

    def merge_action(self) -> None:
        if self.word("DO"):
            self.need("NOTHING")
        elif self.word("UPDATE"):
            self.need("SET")
            if not self.op("*"):
                self.sets()
            if self.word("WHERE"):
                self.expression()
        elif self.word("INSERT"):
            if self.op("*"):
                return
            if self.op("("):
                self.names()
                self.need(")")
            if self.word("OVERRIDING"):
                self.i += 1
                self.need("VALUE")
            if self.word("DEFAULT"):
                return self.need("VALUES")
            self.need("VALUES")
            self.need("(")
            self.items()
            self.need(")")
            if self.word("WHERE"):
                self.expression()
        else:
            self.need("DELETE")

    def rest(self):
        j = self.i
        while self.kind[j] != END and self.text[j] != ";":
            yield self.text[j]
            j += 1

    def skip(self) -> None:
        """One token, or a bracket with all inside it."""
        if self.kind[self.i] == END:
            self.fail()
        self.i = self.match[self.i] + 1 if self.kind[self.i] == OP and self.i in self.match else self.i + 1

    def options(self, *stop: str) -> None:
        """Words, names, literals and lists up to the statement's end or a word of stop, none of which stands where one can't."""
        while self.kind[self.i] != END and not self.is_op(";") and not (stop and self.is_word(*stop)):
            if self.is_op("=", ",", ".", "*", "-", "+", "::", ":=", "=>"):
                if self.text[self.i + 1] in (";", "") or (self.is_op(",") and self.text[self.i + 1] == ","):
                    self.fail()
                self.i += 1
            elif self.kind[self.i] == OP and not self.is_op("(", "["):
                self.fail()
            elif self.kind[self.i] == STRING and self.kind[self.i + 1] == STRING:
                self.fail()
            else:
                self.skip()

    def string(self) -> None:
        if self.kind[self.i] != STRING:
            self.fail()
        self.i += 1

    def ident(self) -> None:
        self.name(_SQL_WORDS)

    def table_name(self) -> None:
        self.ident()
        while self.op("."):
            if not self.op("*"):
                self.name()

    def names(self) -> None:
        self.table_name()
        while self.op(","):
            self.table_name()

    def columns(self) -> None:
        self.need("(")
        self.name()
        while self.op(","):
            self.name()
        self.need(")")

    def value_list(self) -> None:
        n = 0
        while self.kind[self.i] != END and not self.is_op(";"):
            if self.kind[self.i] == OP and not self.is_op(",", "-", "+", "."):
                self.fail()
            self.i += 1
            n += 1
        if not n:
            self.fail()

    # queries

    def query(self) -> None:
        if self.word("WITH"):
            self.word("RECURSIVE")
            while True:
                self.ident()
                if self.is_op("("):
                    self.columns()
                self.need("AS")
                self.word("NOT")
                self.word("MATERIALIZED")
                self.need("(")
                self.statement()
                self.need(")")
                if not self.op(","):
                    break
            if self.is_word("INSERT", "UPDATE", "DELETE", "MERGE"):
                return self.statement()
        self.query_term()
        while self.word("UNION", "INTERSECT", "EXCEPT"):
            self.word("ALL", "DISTINCT")
            self.query_term()
        self.tail()
        return None

    def tail(self) -> None:
        while True:
            if self.word("ORDER"):
                self.need("BY")
                self.order_items()
            elif self.word("LIMIT"):
                if not self.word("ALL"):
                    self.expression()
            elif self.word("OFFSET"):
                self.expression()
                self.word("ROW", "ROWS")
            elif self.word("FETCH"):
                if not self.word("FIRST", "NEXT"):
                    self.fail()
                if self.kind[self.i] == NUMBER:
                    self.i += 1
                if not self.word("ROW", "ROWS"):
                    self.fail()
                if not self.word("ONLY"):
                    self.need("WITH")
                    self.need("TIES")
            elif self.word("FOR"):
                if not self.word("UPDATE", "SHARE", "NO", "KEY"):
                    self.fail()
                while self.kind[self.i] == NAME:
                    self.i += 1
            else:
                return

    def order_items(self) -> None:
        while True:
            self.expression()
            self.word("ASC", "DESC")
            if self.word("NULLS") and not self.word("FIRST", "LAST"):
                self.fail()
            if not self.op(","):
                return

    def query_term(self) -> None:
        if self.op("("):
            self.query()
            return self.need(")")
        if self.word("VALUES"):
            while True:
                self.need("(")
                self.items()
                self.need(")")
                if not self.op(","):
                    return None
        if self.word("TABLE"):
            return self.table_name()
        self.need("SELECT")
        if self.word("DISTINCT"):
            if self.word("ON"):
                self.need("(")
                self.items()
                self.need(")")
        else:
            self.word("ALL")
        if not self.is_word(*_CLAUSES) and self.kind[self.i] != END and not self.is_op(";", ")"):
            while True:
                if not self.op("*"):
                    self.expression()
                    self.alias()
                if not self.op(","):
                    break
        if self.word("INTO"):
            self.word("TEMP", "TEMPORARY", "TABLE", "UNLOGGED")
            self.table_name()
        if self.word("FROM"):
            self.from_items()
        if self.word("WHERE"):
            self.expression()
        if self.word("GROUP"):
            self.need("BY")
            self.items()
        if self.word("HAVING"):
            self.expression()
        if self.word("WINDOW"):
            while True:
                self.ident()
                self.need("AS")
                self.window()
                if not self.op(","):
                    break
        return None

    def alias(self, columns: bool = False) -> None:
        if self.word("AS"):
            self.name()
        elif self.kind[self.i] == NAME and self.text[self.i] not in _SQL_WORDS and not self.is_word("SET", "TABLESAMPLE", "RETURNING"):
            self.i += 1
        else:
            return
        if columns and self.is_op("("):
            self.skip()

    def from_items(self) -> None:
        self.from_item()
        while self.op(","):
            self.from_item()

    def from_item(self) -> None:
        self.source()
        while True:
            if self.word("CROSS"):
                self.need("JOIN")
                self.source()
                continue
            natural = self.word("NATURAL")
            if self.word("LEFT", "RIGHT", "FULL"):
                self.word("OUTER")
                self.need("JOIN")
            elif self.word("INNER"):
                self.need("JOIN")
            elif not self.word("JOIN"):
                if natural:
                    self.fail()
                return
            self.source()
            if not natural:
                if self.word("ON"):
                    self.expression()
                else:
                    self.need("USING")
                    self.columns()

    def source(self) -> None:
        self.word("LATERAL")
        self.word("ONLY")
        if self.op("("):
            if self.is_word("SELECT", "VALUES", "WITH") or self.is_op("("):
                self.query()
            else:
                self.from_item()
            self.need(")")
        elif self.word("ROWS"):
            self.need("FROM")
            self.skip()
        else:
            self.table_name()
            if self.is_op("("):
                self.call()
            self.op("*")
            if self.word("WITH"):
                self.need("ORDINALITY")
        if self.word("TABLESAMPLE"):
            self.ident()
            self.skip()
        self.alias(True)

    def items(self) -> None:
        self.expression()
        while self.op(","):
            self.expression()

    def returning(self) -> None:
        if self.word("RETURNING"):
            while True:
                if not self.op("*"):
                    self.expression()
                    self.alias()
                if not self.op(","):
                    return

    def insert(self) -> None:
        self.i += 1
        self.need("INTO")
        self.table_name()
        if self.word("AS"):
            self.ident()
        if self.is_op("(") and self.text[self.i + 1] not in ("SELECT", "WITH", "VALUES"):
            self.columns()
        if self.word("OVERRIDING"):
            self.i += 1
            self.need("VALUE")
        if self.word("DEFAULT"):
            self.need("VALUES")
        else:
            self.query()
        if self.word("ON"):
            self.need("CONFLICT")
            if self.is_op("("):
                self.skip()
            if self.word("WHERE"):
                self.expression()
            if self.word("ON"):
                self.need("CONSTRAINT")
                self.ident()
            self.need("DO")
            if not self.word("NOTHING"):
                self.need("UPDATE")
                self.need("SET")
                self.sets()
                if self.word("WHERE"):
                    self.expression()
        self.returning()

    def sets(self) -> None:
        while True:
            if self.is_op("("):
                self.columns()
            else:
                self.name()
                while self.is_op("[", "."):
                    self.skip()
                    if self.text[self.i - 1] == ".":
                        self.name()
            self.need("=")
            self.expression()
            if not self.op(","):
                return

    def update(self) -> None:
        self.i += 1
        self.word("ONLY")
        self.table_name()
        self.alias()
        self.need("SET")
        self.sets()
        if self.word("FROM"):
            self.from_items()
        if self.word("WHERE"):
            self.expression()
        self.returning()

    def delete(self) -> None:
        self.i += 1
        self.need("FROM")
        self.word("ONLY")
        self.table_name()
        self.alias()
        if self.word("USING"):
            self.from_items()
        if self.word("WHERE"):
            self.expression()
        self.returning()

    # definitions

    def create(self) -> None:
        self.i += 1
        if self.word("OR"):
            self.need("REPLACE")
        while self.word("TEMP", "TEMPORARY", "UNLOGGED", "GLOBAL", "LOCAL", "MATERIALIZED", "RECURSIVE", "CONSTRAINT"):
            pass
        unique = self.word("UNIQUE")
        t = self.text[self.i] if self.kind[self.i] == NAME else ""
        if unique and t != "INDEX":
            self.fail()
        self.i += 1
        if t == "TABLE":
            self.exists()
            self.table_name()
            if self.word("AS"):
                return self.query()
            if self.word("PARTITION"):
                self.need("OF")
                self.table_name()
            if self.op("("):
                if not self.op(")"):
                    while True:
                        self.table_item()
                        if not self.op(","):
                            break
                    self.need(")")
            elif self.kind[self.i] == END or self.is_op(";"):
                self.fail()
            if self.word("AS"):
                return self.query()
            self.options()
        elif t == "INDEX":
            self.word("CONCURRENTLY")
            self.exists()
            if not self.is_word("ON"):
                self.table_name()
            self.need("ON")
            self.word("ONLY")
            self.table_name()
            if self.word("USING"):
                self.ident()
            self.need("(")
            while True:
                self.expression()
                if self.kind[self.i] == NAME and not self.is_word("ASC", "DESC", "NULLS"):
                    self.table_name()
                self.word("ASC", "DESC")
                if self.word("NULLS"):
                    self.i += 1
                if not self.op(","):
                    break
            self.need(")")
            if self.word("INCLUDE"):
                self.columns()
            if self.word("WITH"):
                self.skip()
            if self.word("TABLESPACE"):
                self.ident()
            if self.word("WHERE"):
                self.expression()
        elif t == "VIEW":
            self.exists()
            self.table_name()
            if self.is_op("("):
                self.columns()
            if self.word("WITH"):
                self.skip()
            self.need("AS")
            self.query()
            if self.word("WITH"):
                self.options()
        elif t in ("FUNCTION", "PROCEDURE"):
            self.table_name()
            if not self.is_op("("):
                self.fail()
            self.skip()
            if not any(x in ("AS", "RETURN", "BEGIN") for x in self.rest()):
                self.fail()
            while self.kind[self.i] != END and not self.is_op(";"):
                if self.is_word("AS"):
                    self.i += 1
                    self.string()
                else:
                    self.skip()
        elif t in ("TRIGGER", "RULE", "POLICY", "AGGREGATE", "CAST", "OPERATOR", "EVENT", "SERVER", "FOREIGN", "PUBLICATION", "SUBSCRIPTION", "STATISTICS", "COLLATION", "CONVERSION", "TEXT", "ACCESS", "LANGUAGE", "TRANSFORM"):
            if self.kind[self.i] == END or self.is_op(";"):
                self.fail()
            while self.kind[self.i] != END and not self.is_op(";"):
                self.skip()
        elif t in ("USER", "ROLE", "GROUP", "DATABASE", "SCHEMA", "EXTENSION", "SEQUENCE", "TYPE", "DOMAIN", "TABLESPACE"):
            self.exists()
            if t == "SCHEMA" and self.word("AUTHORIZATION"):
                return self.ident()
            self.table_name()
            if t in ("USER", "ROLE"):
                for a, b in zip(r := [*self.rest()], [*r[1:], ""]):
                    if a == "PASSWORD" and not (b.startswith("'") or b == "NULL"):
                        self.fail()
            self.options()
        else:
            self.fail()
        return None

    def exists(self) -> None:
        if self.word("IF"):
            self.need("NOT")
            self.need("EXISTS")

    def type(self) -> None:
        self.name(_SQL_WORDS)
        while self.op("."):
            self.name()
        if self.text[self.i - 1] == "DOUBLE":
            self.word("PRECISION")
        if self.text[self.i - 1] in ("CHARACTER", "BIT", "NATIONAL", "CHAR"):
            self.word("VARYING", "CHARACTER", "CHAR")
        if self.text[self.i - 1] == "INTERVAL":
            while self.word("YEAR", "MONTH", "DAY", "HOUR", "MINUTE", "SECOND", "TO"):
                pass
        if self.op("("):
            self.items()
            self.need(")")
        if self.is_word("WITH", "WITHOUT") and self.text[self.i + 1] == "TIME":
            self.i += 2
            self.need("ZONE")
        while self.op("["):
            if self.kind[self.i] == NUMBER:
                self.i += 1
            self.need("]")
        self.word("ARRAY")

    def table_item(self) -> None:
        if self.word("LIKE"):
            self.table_name()
            while self.word("INCLUDING", "EXCLUDING"):
                self.i += 1
            return
        if self.is_word("CONSTRAINT", "PRIMARY", "UNIQUE", "CHECK", "FOREIGN", "EXCLUDE"):
            return self.constraint()
        self.name(_SQL_WORDS)
        if not self.is_op(",", ")"):
            self.type()
        self.column_constraints()

    def column_constraints(self) -> None:
        while self.kind[self.i] == NAME:
            if self.word("CONSTRAINT"):
                self.ident()
            elif self.word("NOT"):
                if not self.word("NULL", "DEFERRABLE", "VALID"):
                    self.fail()
            elif self.word("NULL", "DEFERRABLE", "STORED"):
                pass
            elif self.word("PRIMARY"):
                self.need("KEY")
            elif self.word("UNIQUE"):
                pass
            elif self.word("DEFAULT"):
                self.expression(True)
            elif self.word("CHECK"):
                self.need("(")
                self.expression()
                self.need(")")
            elif self.word("REFERENCES"):
                self.references()
            elif self.word("GENERATED"):
                if not self.word("ALWAYS"):
                    self.need("BY")
                    self.need("DEFAULT")
                self.need("AS")
                if not self.word("IDENTITY"):
                    self.skip()
                elif self.is_op("("):
                    self.skip()
            elif self.word("COLLATE"):
                self.table_name()
            elif self.word("INITIALLY"):
                self.i += 1
            else:
                self.fail()

    def references(self) -> None:
        self.table_name()
        if self.is_op("("):
            self.columns()
        while self.is_word("ON", "MATCH"):
            if self.word("MATCH"):
                self.i += 1
                continue
            self.i += 1
            if not self.word("DELETE", "UPDATE"):
                self.fail()
            if self.word("SET"):
                if not self.word("NULL", "DEFAULT"):
                    self.fail()
            elif self.word("NO"):
                self.need("ACTION")
            elif not self.word("CASCADE", "RESTRICT"):
                self.fail()

    def constraint(self) -> None:
        if self.word("CONSTRAINT"):
            self.ident()
        if self.word("PRIMARY"):
            self.need("KEY")
            self.columns()
        elif self.word("UNIQUE"):
            self.columns()
        elif self.word("CHECK"):
            self.need("(")
            self.expression()
            self.need(")")
        elif self.word("FOREIGN"):
            self.need("KEY")
            self.columns()
            self.need("REFERENCES")
            self.references()
        elif self.word("EXCLUDE"):
            while not self.is_op(",", ")", ";") and self.kind[self.i] != END:
                self.skip()
        else:
            self.fail()
        while self.word("NOT", "DEFERRABLE", "INITIALLY", "DEFERRED", "IMMEDIATE", "VALID"):
            pass

    def alter(self) -> None:
        self.i += 1
        t = self.text[self.i]
        self.i += 1
        if t != "TABLE":
            if self.kind[self.i - 1] != NAME or self.kind[self.i] == END or self.is_op(";"):
                self.fail()
            return self.options()
        if self.word("IF"):
            self.need("EXISTS")
        self.word("ONLY")
        self.table_name()
        self.op("*")
        while True:
            if self.word("ADD"):
                if self.is_word("CONSTRAINT", "PRIMARY", "UNIQUE", "CHECK", "FOREIGN", "EXCLUDE"):
                    self.constraint()
                else:
                    self.word("COLUMN")
                    self.exists()
                    self.name(_SQL_WORDS)
                    self.type()
                    self.column_constraints()
            elif self.word("DROP"):
                self.word("COLUMN", "CONSTRAINT")
                if self.word("IF"):
                    self.need("EXISTS")
                self.ident()
                self.word("CASCADE", "RESTRICT")
            elif self.word("ALTER"):
                self.word("COLUMN")
                self.ident()
                if self.word("TYPE"):
                    self.type()
                    if self.word("USING"):
                        self.expression()
                elif self.word("SET"):
                    if self.word("DATA"):
                        self.need("TYPE")
                        self.type()
                    elif self.word("DEFAULT"):
                        self.expression()
                    elif self.word("NOT"):
                        self.need("NULL")
                    else:
                        self.skip()
                else:
                    self.need("DROP")
                    while self.kind[self.i] == NAME:
                        self.i += 1
            elif self.word("RENAME"):
                if not self.is_word("TO"):
                    self.word("COLUMN", "CONSTRAINT")
                    self.ident()
                self.need("TO")
                self.ident()
            elif self.word("OWNER"):
                self.need("TO")
                self.name()
            elif self.word("SET", "RESET", "ENABLE", "DISABLE", "VALIDATE", "ATTACH", "DETACH", "INHERIT", "NO", "CLUSTER", "REPLICA", "FORCE"):
                if self.kind[self.i] == END or self.is_op(";"):
                    self.fail()
                while not self.is_op(",", ";") and self.kind[self.i] != END:
                    self.skip()
            else:
                self.fail()
            if not self.op(","):
                return None

    # expressions

    def expression(self, plain: bool = False) -> None:
        """plain: a column's default, after which constraints may follow."""
        self.unary()
        while True:
            k, t = self.kind[self.i], self.text[self.i]
            if k == OP:
                if t in _SQL_BINARY:
                    self.i += 1
                    if self.word("ANY", "ALL", "SOME"):
                        self.skip()
                    else:
                        self.unary()
                else:
                    return
            elif k == NAME and not (plain and t in ("NOT", "IN")):
                if t in ("AND", "OR", "LIKE", "ILIKE"):
                    self.i += 1
                    if t in ("LIKE", "ILIKE") and self.word("ANY", "ALL"):
                        self.skip()
                    else:
                        self.unary()
                    if self.word("ESCAPE"):
                        self.unary()
                elif t == "IS":
                    self.i += 1
                    self.word("NOT")
                    if self.word("DISTINCT"):
                        self.need("FROM")
                        self.unary()
                    elif not self.word("NULL", "TRUE", "FALSE", "UNKNOWN", "JSON", "DOCUMENT", "NORMALIZED"):
                        self.fail()
                elif t in ("ISNULL", "NOTNULL"):
                    self.i += 1
                elif t == "NOT" and self.text[self.i + 1] in ("IN", "LIKE", "ILIKE", "BETWEEN", "SIMILAR"):
                    self.i += 1
                elif t == "IN":
                    self.i += 1
                    self.need("(")
                    if self.is_word("SELECT", "WITH", "VALUES"):
                        self.query()
                    else:
                        self.items()
                    self.need(")")
                elif t == "BETWEEN":
                    self.i += 1
                    self.word("SYMMETRIC")
                    self.bound()
                    self.need("AND")
                    self.bound()
                elif t == "SIMILAR":
                    self.i += 1
                    self.need("TO")
                    self.unary()
                elif t == "COLLATE":
                    self.i += 1
                    self.table_name()
                elif t == "AT" and self.text[self.i + 1] == "TIME":
                    self.i += 2
                    self.need("ZONE")
                    self.unary()
                elif t == "OVERLAPS":
                    self.i += 1
                    self.unary()
                else:
                    return
            else:
                return

    def bound(self) -> None:
        self.unary()
        while self.is_op("+", "-", "*", "/", "%", "||"):
            self.i += 1
            self.unary()

    def unary(self) -> None:
        while self.is_op("+", "-", "~", "@", "|/") or self.is_word("NOT"):
            self.i += 1
        k, t = self.kind[self.i], self.text[self.i]
        if k in (NUMBER, STRING):
            self.i += 1
        elif k == OP and t == "(":
            self.i += 1
            if self.is_word("SELECT", "WITH", "VALUES"):
                self.query()
            else:
                self.items()
            self.need(")")
        elif k == OP and t == "*":
            self.i += 1
        elif k == NAME:
            if t == "CASE":
                self.case()
            elif t == "CAST":
                self.i += 1
                self.need("(")
                self.expression()
                self.need("AS")
                self.type()
                self.need(")")
            elif t in ("EXISTS", "ARRAY", "ROW") and self.text[self.i + 1] in ("(", "["):
                self.i += 1
                if self.op("["):
                    if not self.is_op("]"):
                        self.items()
                    self.need("]")
                else:
                    self.need("(")
                    if self.is_word("SELECT", "WITH", "VALUES"):
                        self.query()
                    elif not self.is_op(")"):
                        self.items()
                    self.need(")")
            elif t in ("NULL", "TRUE", "FALSE", "DEFAULT", "USER"):
                self.i += 1
            elif self.kind[self.i + 1] == STRING and t in ("DATE", "TIME", "TIMESTAMP", "TIMESTAMPTZ", "INTERVAL", "NUMERIC", "JSON", "JSONB", "UUID", "BIT", "BOOLEAN", "TEXT"):
                self.i += 2
                while t == "INTERVAL" and self.word("YEAR", "MONTH", "DAY", "HOUR", "MINUTE", "SECOND", "TO"):
                    pass
            else:
                self.name(_SQL_WORDS - {"LEFT", "RIGHT"} if self.text[self.i + 1] == "(" else _SQL_WORDS)
                while self.op("."):
                    if not self.op("*"):
                        self.name()
                if self.is_op("("):
                    self.call()
        else:
            self.fail()
        while True:
            if self.op("::"):
                self.type()
            elif self.is_op("["):
                self.skip()
            elif self.is_op(".") and self.kind[self.i + 1] == NAME:
                self.i += 2
            else:
                return

    def case(self) -> None:
        self.need("CASE")
        if not self.is_word("WHEN"):
            self.expression()
        if not self.is_word("WHEN"):
            self.fail()
        while self.word("WHEN"):
            self.expression()
            self.need("THEN")
            self.expression()
        if self.word("ELSE"):
            self.expression()
        self.need("END")

    def call(self) -> None:
        before = self.text[self.i - 1]
        if before in ("EXTRACT", "SUBSTRING", "TRIM", "OVERLAY", "POSITION", "XMLELEMENT", "JSON_TABLE"):
            if self.text[self.i + 1] == ")":
                self.fail()
            self.skip()
        else:
            self.need("(")
            if not self.op(")"):
                self.word("DISTINCT", "ALL", "VARIADIC")
                if not self.op("*"):
                    if self.is_word("SELECT"):
                        self.query()
                    else:
                        self.items()
                if self.word("ORDER"):
                    self.need("BY")
                    self.order_items()
                self.need(")")
        if self.word("WITHIN"):
            self.need("GROUP")
            self.skip()
        if self.word("FILTER"):
            self.need("(")
            self.need("WHERE")
            self.expression()
            self.need(")")
        if self.word("OVER"):
            if self.is_op("("):
                self.window()
            else:
                self.ident()

    def window(self) -> None:
        self.need("(")
        if self.kind[self.i] == NAME and not self.is_word("PARTITION", "ORDER", "ROWS", "RANGE", "GROUPS"):
            self.i += 1
        if self.word("PARTITION"):
            self.need("BY")
            self.items()
        if self.word("ORDER"):
            self.need("BY")
            self.order_items()
        while not self.is_op(")"):
            self.skip()
        self.need(")")


def check_javascript(text: str) -> None:
    Script(read("javascript", text), False).module()


def check_typescript(text: str) -> None:
    Script(read("javascript", text), True).module()


def check_java(text: str) -> None:
    JavaUnit(read("java", text)).unit()


def check_go(text: str) -> None:
    GoFile(read("go", text)).file()


def check_sql(text: str) -> None:
    SqlScript(read("sql", text)).script()
