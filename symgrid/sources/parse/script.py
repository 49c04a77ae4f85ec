"""JavaScript, TypeScript and TSX: a lexer and a pass over its tokens with a stack of scopes."""

from __future__ import annotations

import re
from dataclasses import dataclass

from symgrid.sources.parse.common import Parsed, count_lines, doc_line, first_lines, heading

_TOKEN = re.compile(
    r"""(?P<space>\s+)|(?P<comment>//[^\n]*|/\*.*?(?:\*/|\Z))|(?P<string>"(?:\\.|[^"\\\n])*(?:"|(?=\n)|\Z)|'(?:\\.|[^'\\\n])*(?:'|(?=\n)|\Z))"""
    r"""|(?P<number>\d[\w.]*)|(?P<word>[#@]?[^\W\d][\w$]*|[#@]?\$[\w$]*)|(?P<op>=>|\.\.\.|\?\.|\?\?=?|[=!]==?|&&=?|\|\|=?|[-+*/%&|^<>]=|\+\+|--|.)""",
    re.S,
)
_BEFORE_REGEX = frozenset("( , = : [ ! & | ? { } ; => && || ?? += -= return typeof case in of delete void throw new await yield else do".split()) | {"(", "["}
_REGEX = re.compile(r"/(?![*/])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/[a-z]*")
_WORDS = frozenset("if for while switch catch return typeof function new await yield super import require delete void in of do else case throw with instanceof class const let var async static get set".split())
_MODIFIERS = frozenset("public private protected readonly static abstract override declare async get set accessor".split())
_TYPES = frozenset("string number boolean void any unknown never null undefined object symbol bigint this true false".split())


@dataclass
class Tok:
    kind: str
    text: str
    at: int
    line: int


def lexed(text: str) -> tuple[list[Tok], list[Tok], bool]:
    """Tokens without space and comments, the comments, and whether something never ends."""
    out: list[Tok] = []
    comments: list[Tok] = []
    at, line, n = 0, 1, len(text)
    templates: list[int] = []
    braces = 0
    broken = False
    while at < n:
        if text[at] == "`" or (text[at] == "}" and templates and templates[-1] == braces):
            if text[at] == "}":
                templates.pop()
                braces -= 1
            start, i = at, at + 1
            while i < n and text[i] != "`" and not text.startswith("${", i):
                i += 2 if text[i] == "\\" else 1
            if i >= n:
                broken, end = True, n
            elif text[i] == "`":
                end = i + 1
            else:
                end = i + 2
                braces += 1
                templates.append(braces)
            out.append(Tok("string", text[start:end], start, line))
            line += text.count("\n", start, end)
            at = end
            continue
        if text[at] == "/" and (not out or out[-1].text in _BEFORE_REGEX) and (m := _REGEX.match(text, at)):
            kind = "regex"
        else:
            m = _TOKEN.match(text, at)
            kind = m.lastgroup or "op"
        token = Tok(kind, m[0], at, line)
        if kind == "comment":
            comments.append(token)
            broken |= m[0].startswith("/*") and not m[0].endswith("*/")
        elif kind != "space":
            out.append(token)
            if m[0] == "{":
                braces += 1
            elif m[0] == "}":
                braces -= 1
        line += m[0].count("\n")
        at = m.end()
    return out, comments, broken


class _Reader:
    def __init__(self, out: Parsed, text: str, typed: bool) -> None:
        self.out, self.text, self.typed = out, text, typed
        self.toks, self.comments, broken = lexed(text)
        self.match: dict[int, int] = {}
        stack: list[int] = []
        for i, t in enumerate(self.toks):
            if t.kind == "op" and t.text in "([{":
                stack.append(i)
            elif t.kind == "op" and t.text in ")]}":
                if stack and self.toks[stack[-1]].text + t.text in ("()", "[]", "{}"):
                    self.match[stack.pop()] = i
                else:
                    broken = True
        out.truncated = broken or bool(stack)
        for i in stack:
            self.match[i] = len(self.toks) - 1
        self.ends = {t.line + t.text.count("\n"): t for t in self.comments}

    def tok(self, i: int) -> str:
        return self.toks[i].text if 0 <= i < len(self.toks) else ""

    def word(self, i: int) -> bool:
        return 0 <= i < len(self.toks) and self.toks[i].kind == "word"

    def source(self, a: int, b: int) -> str:
        """Text from token a up to token b."""
        end = self.toks[b].at if b < len(self.toks) else len(self.text)
        return self.text[self.toks[a].at : end]

    def end_line(self, i: int) -> int:
        t = self.toks[min(i, len(self.toks) - 1)]
        return t.line + t.text.count("\n")

    def doc(self, i: int) -> str:
        """The comment that ends on the line before token i."""
        c = self.ends.get(self.toks[i].line - 1)
        if c is None or self.text[self.text.rfind("\n", 0, c.at) + 1 : c.at].strip():
            return ""
        text = c.text[2:]
        if c.text.startswith("/*"):
            text = "\n".join(re.sub(r"^\s*\*+ ?", "", x) for x in text.removesuffix("*/").lstrip("*").split("\n"))
        return doc_line(text)

    def skip_type(self, i: int) -> int:
        """Past a type annotation that starts at i, up to what ends it at this level."""
        depth = 0
        while i < len(self.toks):
            t = self.toks[i].text
            if t in ("(", "[", "{"):
                if t == "{" and depth == 0 and self.tok(i - 1) not in (":", "|", "&", "=", "<", ",", "=>", "is", "keyof", "extends"):
                    return i
                i = self.match.get(i, len(self.toks) - 1)
            elif t == "<":
                depth += 1
            elif t == ">" and depth:
                depth -= 1
            elif depth == 0 and t in (")", "]", "}", ";", ",", "="):
                return i
            i += 1
        return i

    def generics(self, i: int) -> int:
        """Past <...> at i, if it is one."""
        if self.tok(i) != "<":
            return i
        depth = 0
        for j in range(i, min(i + 400, len(self.toks))):
            t = self.toks[j].text
            if t in ("(", "{", "["):
                continue
            depth += (t == "<") - (t == ">")
            if depth == 0:
                return j + 1
        return i

    def statement_end(self, i: int) -> int:
        """The token after a statement that starts at i: a semicolon, a closing brace, or a new line that can't go on."""
        start = i
        while i < len(self.toks):
            t = self.toks[i]
            if t.text == ";":
                return i + 1
            if t.kind == "op" and t.text in (")", "]", "}"):
                return i
            if i > start and t.line > self.end_line(i - 1):
                before = self.toks[i - 1]
                goes_on = (before.kind == "op" and before.text not in (")", "]", "}", "++", "--")) or t.text in (".", "?.", "?", ":", "=>", "=", "&&", "||", "??", "+", "-", "*", "|", "&", ",", ")", "]", "}", "extends", "as", "satisfies", "in", "of", "instanceof", "(", "[", "{")
                if not goes_on and not before.text.startswith("${"):
                    return i
            if t.kind == "op" and t.text in ("(", "[", "{"):
                i = self.match.get(i, len(self.toks) - 1)
            i += 1
        return i

    def function_body(self, i: int) -> int:
        """The opening brace of a body after parameters at i, or -1."""
        i = self.generics(i)
        if self.tok(i) != "(":
            return -1
        i = self.match.get(i, len(self.toks) - 1) + 1
        if self.tok(i) == ":":
            i = self.skip_type(i + 1)
        return i if self.tok(i) == "{" else -1

    def define(self, name: str, kind: str, start: int, name_at: int, body: int, end: int, scope: tuple[str, ...], exported: bool, doc_at: int, prefix: str = "") -> None:
        text = self.source(start, body) if body >= 0 else self.source(start, end)
        signature = heading(prefix + text) if body >= 0 else first_lines(prefix + text)
        self.out.define(".".join((*scope, name)), kind, self.toks[start].line, self.end_line(max(start, (body >= 0 and self.match.get(body, end)) or end - 1)), signature, self.doc(doc_at), exported)

    def block(self, i: int, end: int, scope: tuple[str, ...], module: bool, exported: bool = False) -> None:
        """Statements between two tokens; module: names bound here can be reached from outside."""
        while i < end:
            i = max(i + 1, self.statement(i, end, scope, module, exported))

    def statement(self, i: int, end: int, scope: tuple[str, ...], module: bool, within: bool) -> int:
        first = i
        exported = within
        while self.tok(i) in ("export", "default", "declare", "abstract", "async") or self.tok(i).startswith("@"):
            if self.tok(i).startswith("@"):
                i += 1
                while self.tok(i) == ".":
                    i += 2
                if self.tok(i) == "(":
                    i = self.match.get(i, end) + 1
                continue
            if self.tok(i) == "export":
                exported = True
                if self.tok(i + 1) in ("*", "{") or self.tok(i + 1) == "type" and self.tok(i + 2) == "{":
                    return self.reexport(i, end)
            if self.tok(i) in ("async", "declare", "abstract") and not self.word(i + 1):
                break
            i += 1
        head = i - (self.tok(i - 1) in ("async", "abstract", "declare") and i > first)
        t = self.tok(i)
        if t == "import" and self.tok(i + 1) not in ("(", "."):
            return self.imports(i)
        if t == "function":
            at = i + 1 + (self.tok(i + 1) == "*")
            if self.word(at):
                body = self.function_body(at + 1)
                stop = self.match.get(body, end) + 1 if body >= 0 else self.statement_end(at)
                self.define(self.tok(at), "function", head, at, body, stop, scope, exported, first)
                if body >= 0:
                    self.expressions(at + 1, body, scope)
                    self.block(body + 1, stop - 1, (*scope, self.tok(at)), False)
                return stop
        if t == "class" and (self.word(i + 1) or self.tok(i + 1) == "{"):
            named = self.word(i + 1) and self.tok(i + 1) not in ("extends", "implements")
            at = i + 1 if named else i
            body = at + 1
            while body < end and self.tok(body) != "{":
                body = self.generics(body) if self.tok(body) == "<" and self.generics(body) > body else body + 1
            stop = self.match.get(body, end) + 1
            if named:
                self.define(self.tok(at), "class", head, at, body, stop, scope, exported, first)
            self.heritage(at + 1, body)
            self.members(body, stop - 1, (*scope, self.tok(at)) if named else scope, exported)
            return stop
        if self.typed and t in ("interface", "enum", "namespace", "module") or self.typed and t == "const" and self.tok(i + 1) == "enum":
            at = i + 1 + (t == "const")
            if self.word(at) or self.toks[at].kind == "string" and t == "module":
                body = at + 1
                name = self.tok(at)
                while self.tok(body) == ".":
                    name += "." + self.tok(body + 1)
                    body += 2
                while body < end and self.tok(body) != "{" and self.tok(body) != ";":
                    body += 1
                if self.tok(body) == "{":
                    stop = self.match.get(body, end) + 1
                    kind = "interface" if t == "interface" else "module" if t in ("namespace", "module") else "enum"
                    self.define(name.strip("\"'"), kind, head, at, body, stop, scope, exported, first)
                    if kind == "module":
                        self.block(body + 1, stop - 1, (*scope, name.strip("\"'")), module, exported)
                    elif kind == "interface":
                        self.heritage(at + 1, body)
                        self.members(body, stop - 1, (*scope, name), exported)
                    return stop
        if self.typed and t == "type" and self.word(i + 1) and self.tok(self.generics(i + 2)) == "=":
            stop = self.statement_end(self.generics(i + 2) + 1)
            self.define(self.tok(i + 1), "type", head, i + 1, -1, stop, scope, exported, first)
            self.type_refs(i + 2, stop)
            return stop
        if t in ("const", "let", "var") and (self.word(i + 1) or self.tok(i + 1) in ("{", "[")):
            return self.binding(i, end, scope, module, exported, first)
        if t == "{":
            stop = self.match.get(i, end)
            self.block(i + 1, stop, scope, False)
            return stop + 1
        if t in ("if", "for", "while", "switch", "catch", "with") and self.tok(i + 1) == "(":
            stop = self.match.get(i + 1, end)
            self.expressions(i + 2, stop, scope)
            return stop + 1
        if t in ("else", "do", "try", "finally", "static") and self.tok(i + 1) == "{":
            return i + 1
        stop = min(self.statement_end(i), end)
        self.expressions(i, max(stop, i + 1), scope)
        return max(stop, i + 1)

    def binding(self, i: int, end: int, scope: tuple[str, ...], module: bool, exported: bool, first: int) -> int:
        """Names bound by const, let or var: functions anywhere, values where the module can see them."""
        keyword = self.tok(i)
        stop = self.statement_end(i + 1)
        at = i + 1
        while at < stop:
            if not self.word(at):
                if self.tok(at) in ("{", "["):  # a pattern names parts of something else
                    at = self.match.get(at, stop) + 1
                    if self.tok(at) == "=":
                        nxt = self.comma(at + 1, stop)
                        self.expressions(at + 1, nxt, scope)
                        at = nxt
                    at += 1
                    continue
                break
            name, k = at, at + 1
            if self.tok(k) == "!":
                k += 1
            if self.tok(k) == ":":
                a = k + 1
                k = self.skip_type(k + 1)
                self.type_refs(a, k)
            nxt = self.comma(k, stop)
            if self.tok(k) == "=":
                self.bound(name, k + 1, nxt, scope, module, exported, first, keyword)
            elif module and keyword == "const" and self.typed:
                self.define(self.tok(name), "constant", name, name, -1, nxt, scope, exported, first, keyword + " ")
            at = nxt + 1
        return stop

    def comma(self, i: int, stop: int) -> int:
        while i < stop and self.tok(i) not in (",", ";"):
            i = self.match.get(i, stop - 1) + 1 if self.toks[i].kind == "op" and self.tok(i) in ("(", "[", "{") else i + 1
        return min(i, stop)

    def bound(self, name: int, value: int, stop: int, scope: tuple[str, ...], module: bool, exported: bool, doc_at: int, keyword: str) -> None:
        body, arrow = self.function_value(value, stop)
        word = self.tok(name)
        if body >= 0 or arrow >= 0:
            cut = body if body >= 0 else arrow + 1
            self.out.define(".".join((*scope, word)), "function", self.toks[name].line, self.end_line(max(name, stop - 1)), heading((keyword + " " if keyword else "") + self.source(name, cut)), self.doc(doc_at), exported)
            self.expressions(value, cut, scope)
            own = value + (self.tok(value) == "async")
            own += 1 + (self.tok(own + 1) == "*")
            if self.tok(own - 1) in ("function", "*") and self.word(own):  # a name that the function has inside
                self.define(self.tok(own), "function", value, own, body, stop, (*scope, word), exported, value)
            if body >= 0:
                self.block(body + 1, self.match.get(body, stop), (*scope, word), False)
            else:
                self.expressions(arrow + 1, stop, (*scope, word))
            return
        if module and keyword == "const":
            self.define(word, "constant", name, name, -1, stop, scope, exported, doc_at, keyword + " ")
        inner = value
        while self.tok(inner) == "(" or self.word(inner) and self.tok(inner + 1) in ("(", ".") and self.tok(inner) in ("Object",):
            inner += 1 if self.tok(inner) == "(" else 3 if self.tok(inner + 1) == "." else 1
        if self.tok(inner) == "{" and module:
            self.pairs(inner, self.match.get(inner, stop), (*scope, word), exported)
        elif self.tok(value) == "class":
            at = value + 1
            while at < stop and self.tok(at) != "{":
                at += 1
            self.heritage(value + 1, at)
            self.members(at, self.match.get(at, stop), (*scope, word), exported)
        else:
            self.expressions(value, stop, scope)

    def function_value(self, i: int, stop: int) -> tuple[int, int]:
        """(opening brace of the body, the arrow of an arrow without one) of a function value; -1 where there is none."""
        if self.tok(i) == "async" and self.tok(i + 1) != ",":
            i += 1
        if self.tok(i) == "function":
            i += 1 + (self.tok(i + 1) == "*")
            if self.word(i):
                i += 1
            return self.function_body(i), -1
        k = self.generics(i)
        if self.tok(k) == "(":
            k = self.match.get(k, stop) + 1
            if self.tok(k) == ":":
                while k < stop and self.tok(k) != "=>":
                    k = self.match.get(k, stop) + 1 if self.tok(k) in ("(", "[", "{") else k + 1
        elif self.word(k):
            k += 1
        if self.tok(k) == "=>" and k < stop:
            return (k + 1, -1) if self.tok(k + 1) == "{" else (-1, k)
        return -1, -1

    def pairs(self, open_: int, close: int, scope: tuple[str, ...], exported: bool) -> None:
        """Methods and function values of an object that has a name."""
        i = open_ + 1
        while i < close:
            nxt = self.comma(i, close)
            k = i
            while self.tok(k) in ("async", "get", "set", "*") and (self.word(k + 1) or self.tok(k + 1) == "*"):
                k += 1
            key = self.tok(k).strip("\"'")
            named = self.word(k) or self.toks[k].kind == "string" and not self.tok(k).startswith("`")
            if named and self.tok(k + 1) in ("(", "<"):
                body = self.function_body(k + 1)
                if body >= 0:
                    self.define(key, "method", i, k, body, nxt, scope, exported, i)
                    self.block(body + 1, self.match.get(body, close), (*scope, key), False)
            elif named and self.tok(k + 1) == ":":
                body, arrow = self.function_value(k + 2, nxt)
                if body >= 0 or arrow >= 0:
                    cut = body if body >= 0 else arrow + 1
                    self.out.define(".".join((*scope, key)), "function", self.toks[k].line, self.end_line(nxt - 1), heading(self.source(k, cut)), self.doc(i), exported)
                    if body >= 0:
                        self.block(body + 1, self.match.get(body, close), (*scope, key), False)
                    else:
                        self.expressions(arrow + 1, nxt, scope)
                elif self.tok(k + 2) == "{":
                    self.pairs(k + 2, self.match.get(k + 2, close), (*scope, key), exported)
                else:
                    self.expressions(k + 2, nxt, scope)
            else:
                self.expressions(i, nxt, scope)
            i = nxt + 1

    def members(self, open_: int, close: int, scope: tuple[str, ...], exported: bool) -> None:
        """Methods and function-valued fields of a class or interface body; constructors aren't symbols."""
        i = open_ + 1
        while i < close:
            start = i
            while self.tok(i).startswith("@"):
                i += 1
                if self.tok(i) == "(":
                    i = self.match.get(i, close) + 1
            head = i
            while self.tok(i) in _MODIFIERS | {"*"} and self.tok(i + 1) not in ("(", "=", ":", ";", "?", "<") or self.tok(i) == "*":
                i += 1
            if self.tok(i) == "{":
                self.block(i + 1, self.match.get(i, close), scope, False)
                i = self.match.get(i, close) + 1
                continue
            if not self.word(i) and self.toks[min(i, close)].kind not in ("string", "number"):
                i = self.match.get(i, close) + 1 if self.tok(i) in ("[", "(", "{") else i + 1
                continue
            key, k = self.tok(i).strip("\"'"), i + 1
            if self.tok(k) in ("?", "!"):
                k += 1
            if self.tok(k) in ("(", "<"):
                body = self.function_body(k)
                if body >= 0:
                    stop = self.match.get(body, close) + 1
                    if key != "constructor":
                        self.define(key, "method", head, i, body, stop, scope, exported, start)
                    self.expressions(k, body, scope)
                    self.block(body + 1, stop - 1, (*scope, key), False)
                else:
                    stop = self.statement_end(k)
                    if key != "constructor":
                        self.define(key, "method", head, i, -1, stop, scope, exported, start)
                    self.type_refs(k, stop)
                i = stop
                continue
            stop = min(self.statement_end(i), close)
            if self.tok(k) == ":":
                a = k + 1
                k = self.skip_type(k + 1)
                self.type_refs(a, min(k, stop))
            if self.tok(k) == "=" and k < stop:
                body, arrow = self.function_value(k + 1, stop)
                if body >= 0 or arrow >= 0:
                    cut = body if body >= 0 else arrow + 1
                    self.out.define(".".join((*scope, key)), "method", self.toks[head].line, self.end_line(stop - 1), heading(self.source(head, cut)), self.doc(start), exported)
                    if body >= 0:
                        self.block(body + 1, self.match.get(body, close), (*scope, key), False)
                    else:
                        self.expressions(arrow + 1, stop, scope)
                else:
                    self.expressions(k + 1, stop, scope)
            i = max(stop, i + 1)

    def heritage(self, i: int, body: int) -> None:
        while i < body:
            if self.tok(i) in ("extends", "implements"):
                i += 1
                while i < body and self.tok(i) not in ("implements", "{"):
                    if self.word(i) and self.tok(i + 1) != ".":
                        self.out.refer(self.tok(i), "class" if not self.typed or self.tok(i - 1) == "extends" else "type", self.toks[i].line)
                    nxt = self.generics(i + 1)
                    self.type_refs(i + 1, nxt)
                    i = max(nxt, i + 1)
                continue
            i += 1

    def type_refs(self, i: int, end: int) -> None:
        """Named types of an annotation."""
        while i < min(end, len(self.toks)):
            if self.word(i) and self.tok(i)[0].isupper() and self.tok(i) not in _TYPES and self.tok(i + 1) not in (".", ":") and self.tok(i + 1) != "?":
                self.out.refer(self.tok(i), "type", self.toks[i].line)
            i += 1

    def expressions(self, i: int, end: int, scope: tuple[str, ...]) -> None:
        """Calls, constructions, requires and nested functions of an expression."""
        while i < min(end, len(self.toks)):
            t = self.toks[i]
            if t.text == "function":
                k = i + 1 + (self.tok(i + 1) == "*")
                name = self.tok(k) if self.word(k) else ""
                body = self.function_body(k + bool(name))
                if body >= 0:
                    self.block(body + 1, self.match.get(body, end), (*scope, name) if name else scope, False)
                    i = self.match.get(body, end) + 1
                    continue
            if t.text == "=>" and self.tok(i + 1) == "{":
                self.block(i + 2, self.match.get(i + 1, end), scope, False)
                i = self.match.get(i + 1, end) + 1
                continue
            if t.text == "class" and self.tok(i - 1) != ".":
                i = self.statement(i, end, scope, False, False)
                continue
            if t.text == "new" and self.word(i + 1):
                k = i + 1
                while self.tok(k + 1) == "." and self.word(k + 2):
                    k += 2
                self.out.refer(self.tok(k), "class", self.toks[k].line)
                i = k + 1
                continue
            if t.text in ("require", "import") and self.tok(i + 1) == "(" and i + 2 < len(self.toks) and self.toks[i + 2].kind == "string" and self.tok(i - 1) != ".":
                self.out.refer(self.tok(i + 2).strip("\"'`"), "import", self.toks[i + 2].line)
                i += 2
                continue
            if t.kind == "word" and t.text not in _WORDS and not t.text.startswith("@"):
                k = i + 1
                if self.tok(k) == "?." and self.tok(k + 1) == "(":
                    k += 1
                elif self.tok(k) == "<" and self.typed:
                    g = self.generics(k)
                    k = g if g > k and self.tok(g) == "(" and g - k < 40 else k
                if self.tok(k) == "(":
                    self.out.refer(t.text, "call", t.line)
            if self.typed and t.text in ("as", "satisfies") and self.word(i + 1) and self.tok(i + 1) != "const":
                self.type_refs(i + 1, i + 2)
            if self.typed and t.text == ":" and self.word(i + 1) and self.tok(i + 1)[0].isupper() and self.tok(i - 1) not in ("case", "default"):
                self.type_refs(i + 1, i + 2)
            i += 1

    def imports(self, i: int) -> int:
        """Original names of named imports and the module itself; default and namespace bindings are local names."""
        stop = self.statement_end(i)
        for k in range(i, stop):
            t = self.toks[k]
            if t.kind == "string":
                self.out.refer(t.text.strip("\"'`"), "import", t.line)
                return k + 1 + (self.tok(k + 1) == ";")
            if t.text == "{":
                self.named(k)
        return stop

    def named(self, k: int) -> None:
        for j in range(k + 1, self.match.get(k, k)):
            if self.word(j) and self.tok(j - 1) in ("{", ",", "type") and self.tok(j) not in ("type", "default") or self.tok(j) == "type" and self.tok(j - 1) in ("{", ",") and self.tok(j + 1) in (",", "}"):
                self.out.refer(self.tok(j), "import", self.toks[j].line)

    def reexport(self, i: int, end: int) -> int:
        stop = self.statement_end(i)
        source = next((k for k in range(i, stop) if self.toks[k].kind == "string" and self.tok(k - 1) == "from"), -1)
        if source >= 0:
            self.out.refer(self.tok(source).strip("\"'`"), "import", self.toks[source].line)
            for k in range(i, source):
                if self.tok(k) == "{":
                    self.named(k)
            return source + 1 + (self.tok(source + 1) == ";")
        return stop


def parse_script(path: str, text: str, language: str) -> Parsed:
    out = Parsed(path, language, count_lines(text))
    reader = _Reader(out, text, language in ("typescript", "tsx"))
    reader.block(0, len(reader.toks), (), True)
    return out
