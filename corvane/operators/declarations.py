"""Declarations, calls and variable types of a source file, from its tokens: a scope tree by tables of a language's words.

Statement by statement a scope is read: annotations and modifiers go by, a word of `types` opens a type with its bases and its body (read in turn), a word of `functions` or, where
the language writes none, a name before brackets after a type makes a function. What is left are statements. Each call, each type that is named and each variable
whose type is written (or plain from what it is set to) belongs to the innermost declaration around it.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from corvane.operators.lexer import LEXICONS, Tokens

CONTAINERS = {"class", "interface", "struct", "enum", "record", "impl"}
NOT_CALLS = frozenset("if for while switch catch return sizeof typeof function func fn def when match synchronized using lock foreach elseif elsif unless until defined super this self new throw await async yield in is as and or not else do try case".split())
#: Words that may stand before a call, so that name and brackets after them are no declaration.
_BEFORE_CALL = NOT_CALLS | {"delete", "then", "puts", "print", "echo", "go", "defer", "range", "in", "by", "comptime", "orelse", "mut", "ref", "move", "assert", "unsafe", "const"}
_MODIFIERS = frozenset(
    "public private protected internal static final abstract sealed open override export default async declare readonly virtual inline partial data inner suspend operator lateinit constexpr consteval extern unsafe pub case implicit lazy external native synchronized transient volatile strictfp factory late covariant base explicit friend actual expect tailrec infix annotation value companion var mutable typedef packed threadlocal noinline crossinline vararg required unowned file non-sealed".split()
)
_T = {"class": ("class", "class"), "interface": ("interface", "interface"), "enum": ("enum", "enum")}


@dataclass(frozen=True)
class Grammar:
    #: A word that opens a type: component type, and what the language calls it.
    types: dict[str, tuple[str, str]]
    functions: frozenset[str] = frozenset()
    modifiers: frozenset[str] = _MODIFIERS
    #: Words before lists of bases, and whether a colon is one.
    bases: tuple[str, ...] = ("extends", "implements", "with")
    colon: bool = False
    #: Functions are names before brackets: in types, and also outside of them.
    members: bool = False
    outside: bool = False
    #: Where types of variables are written: before or after their names, after a blank (go), or nowhere.
    typed: str = ""
    #: Blocks that are looked through.
    through: frozenset[str] = frozenset(["namespace"])
    unnamed: bool = False


GRAMMARS = {
    "javascript": Grammar(_T, frozenset(["function"]), members=True, modifiers=_MODIFIERS - {"var", "data", "value", "open", "base", "case", "file", "internal"}),
    "java": Grammar(_T | {"record": ("record", "record")}, members=True, typed="before", modifiers=_MODIFIERS - {"var", "case"}),
    "csharp": Grammar(_T | {"struct": ("struct", "struct"), "record": ("record", "record"), "delegate": ("class", "delegate")}, members=True, colon=True, bases=(), typed="before", modifiers=_MODIFIERS - {"var", "case", "base", "value"} | {"new", "ref", "fixed"}),
    "c": Grammar({"struct": ("struct", "struct"), "union": ("struct", "union")}, outside=True, bases=(), typed="before", modifiers=frozenset(["typedef", "static", "extern", "inline", "register", "_Noreturn"])),
    "cpp": Grammar({"class": ("class", "class"), "struct": ("struct", "struct"), "union": ("struct", "union"), "enum": ("enum", "enum")}, members=True, outside=True, bases=(), colon=True, typed="before", modifiers=frozenset("typedef static extern inline virtual explicit friend constexpr consteval mutable volatile typename".split())),
    "kotlin": Grammar(_T | {"object": ("class", "object")}, frozenset(["fun", "constructor"]), bases=(), colon=True, typed="after", modifiers=_MODIFIERS - {"var", "case", "default", "base", "file"}),
    "php": Grammar(_T | {"trait": ("class", "trait")}, frozenset(["function"]), typed="before"),
    "scala": Grammar({"trait": ("interface", "trait"), "object": ("class", "object"), "class": ("class", "class"), "enum": ("enum", "enum")}, frozenset(["def"]), bases=("extends", "with", "derives"), typed="after"),
    "rust": Grammar({"struct": ("struct", "struct"), "union": ("struct", "union"), "enum": ("enum", "enum"), "trait": ("interface", "trait"), "impl": ("impl", "impl")}, frozenset(["fn"]), bases=(), colon=True, typed="after", through=frozenset(["mod"]), modifiers=frozenset("pub async const unsafe extern default".split())),
    "dart": Grammar(_T | {"mixin": ("class", "mixin"), "extension": ("class", "extension")}, members=True, outside=True, bases=("extends", "with", "implements", "on"), typed="before", through=frozenset(), modifiers=_MODIFIERS - {"case", "value", "operator", "var"} | {"const"}),
    "go": Grammar({}, frozenset(["func"]), typed="go", through=frozenset()),
    "zig": Grammar({}, frozenset(["fn"]), typed="after", through=frozenset(), modifiers=frozenset("pub export inline extern noinline".split())),
}
GRAMMARS["typescript"] = Grammar(_T | {"type": ("type_alias", "type")}, frozenset(["function"]), members=True, typed="after", through=frozenset(["namespace", "module", "global"]), modifiers=GRAMMARS["javascript"].modifiers)
#: Types that answer to what they hold: pointers, and what is awaited.
_WRAPPERS = {"Box", "Rc", "Arc", "Ref", "Promise", "Task", "ValueTask", "Future", "FutureOr", "unique_ptr", "shared_ptr"}
_GOES_ON = frozenset("{ : = . ?. , ) ] => -> && || + ? | & extends implements with where throws else catch finally by".split())
_WENT_ON = frozenset("= , : ( [ => -> && || + - * / . ?. | & < := extends implements with throws by".split())


@dataclass
class Declaration:
    kind: str
    node: str
    name: str
    start: int
    end: int
    up: Declaration | None
    head: int = 0
    body: int = 0
    bases: list[str] = field(default_factory=list)
    params: tuple[int, int] | None = None
    owner: str = ""
    receiver: str = ""
    id: str = ""

    def path(self) -> str:
        own = self.name.replace("::", ".")
        before = self.owner or (self.up.path() if self.up else "")
        return f"{before}.{own}" if before else own


class Reader:
    def __init__(self, text: str, language: str):
        self.language, self.g = language, GRAMMARS.get(language)
        self.t = Tokens(text, LEXICONS[language])
        self.x, self.k, self.pair, self.n = self.t.text, self.t.kind, self.t.pair, len(self.t)
        self.found: list[Declaration] = []
        if language == "ruby":
            self.ruby(0, self.n, None)
        else:
            self.scope(0, self.n, None)
        self.of: list[Declaration | None] = [None] * self.n
        for d in self.found:
            self.of[d.start : d.end] = [d] * (min(d.end, self.n) - d.start)

    # ---- moving

    def word(self, i: int, j: int | None = None) -> str:
        return self.x[i] if 0 <= i < (self.n if j is None else min(j, self.n)) and self.k[i] == "w" else ""

    def text(self, i: int) -> str:
        return self.x[i] if 0 <= i < self.n and self.k[i] != "s" else ""

    def next(self, i: int, j: int) -> int:
        while i < j and self.k[i] == "l":
            i += 1
        return i

    def close(self, i: int, j: int) -> int:
        return min(self.pair.get(i, j), j)

    def line_ends(self, i: int, j: int) -> bool:
        """Whether the line's end at `i` ends a statement."""
        n, p = self.next(i, j), i - 1
        while p >= 0 and self.k[p] == "l":
            p -= 1
        went_on = p >= 0 and self.k[p] != "s" and self.x[p] in _WENT_ON and not (self.language == "go" and self.x[p] in "*&")
        return not went_on and (n >= j or self.language == "go" or self.k[n] == "s" or self.x[n] not in _GOES_ON)

    def statement(self, i: int, j: int) -> int:
        """The place after the statement that starts at `i`."""
        while i < j:
            x = self.text(i)
            if self.k[i] == "l":
                if self.line_ends(i, j):
                    return i + 1
            elif x == ";" or x == "," and self.language == "zig":
                return i + 1
            elif x == "}":
                return i
            elif x and x in "([":
                i = self.close(i, j)
            elif x == "{":
                i = self.next(self.close(i, j) + 1, j)
                after = self.text(i)
                if after == ";":
                    return i + 1
                if after not in (",", ".", "?.", "(", "=", "else", "catch", "finally", "&&", "||", ")", "?", ":"):
                    return i
                continue
            i += 1
        return j

    def head(self, i: int, j: int) -> int:
        """The first place from `i` on with what ends a declaration's head: a block, an equals sign or arrow, the statement's end."""
        while i < j:
            x = self.text(i)
            if self.k[i] == "l":
                if self.line_ends(i, j):
                    return i
            elif x in ("{", ";", "=", "=>", "}"):
                return i
            elif x and x in "([":
                i = self.close(i, j)
            elif x == "<" and (to := self.t.angles(i, j)) > i:
                i = to
                continue
            i += 1
        return j

    def dotted(self, i: int, j: int) -> tuple[str, int]:
        """A name with its qualifiers from `i` on, and the place after it."""
        if self.text(i) == "\\":
            i += 1
        if not self.word(i, j):
            return "", i
        out = self.x[i]
        i += 1
        while i + 1 < j and self.text(i) in ((".", "::") if self.language != "php" else ("::", "\\")) and self.word(i + 1, j):
            out += ("." if self.x[i] == "." else self.x[i]) + self.x[i + 1]
            i += 2
        return out, i

    # ---- scopes

    def scope(self, i: int, j: int, up: Declaration | None) -> None:
        while i < j:
            if self.k[i] == "l" or self.text(i) in (";", ",", "}"):
                i += 1
                continue
            to = self.declaration(i, j, up)
            i = max(i + 1, self.statement(i, j) if to is None else to)

    def prefix(self, i: int, j: int) -> tuple[int, set[str], bool]:
        """The place after annotations and modifiers, the modifiers, and whether an annotation marks tests."""
        seen, test = set(), False
        while i < j:
            x, after = self.text(i), self.text(i + 1)
            if self.k[i] == "l":
                i += 1
            elif x == "@" and after != "interface" or x.startswith("@") and len(x) > 1 and self.language in ("javascript", "typescript"):
                _, i = self.dotted(i + (x == "@"), j)
                if self.text(i) == ":" and self.language == "kotlin":  # @file:Name, @get:Name
                    _, i = self.dotted(i + 1, j)
                if self.text(i) == "(":
                    i = self.close(i, j) + 1
            elif x == "[" and self.language in ("csharp", "cpp"):
                i = self.close(i, j) + 1
            elif x == "#" and after in ("[", "!"):
                at = i + 1 if after == "[" else i + 2
                to = self.close(at, j)
                test |= "cfg" in self.x[at:to] and "test" in self.x[at:to] and "not" not in self.x[at:to]
                i = to + 1
            elif x == "template" and self.language == "cpp":
                to = self.t.angles(i + 1, j)
                i = max(to, i + 1)
            elif x in ("__attribute__", "__declspec", "alignas") and after == "(":
                i = self.close(i + 1, j) + 1
            elif x == "const" and after == "enum":
                i += 1
            elif self.language == "cpp" and x in ("public", "private", "protected", "signals", "slots") and after == ":":
                i += 2
            elif self.k[i] == "w" and x in self.g.modifiers and after not in ("(", "=", ":", ";", ",", ".", "=>", "?", ")", "::") or x == "pub" and after == "(":
                seen.add(x)
                i += 1
                if x == "pub" and self.text(i) == "(":
                    i = self.close(i, j) + 1
                elif x == "extern" and i < j and self.k[i] == "s":
                    i += 1
                elif x == "private" and self.text(i) == "[":  # Scala
                    i = self.close(i, j) + 1
            elif self.language in ("c", "cpp") and re.fullmatch(r"[A-Z][A-Z0-9_]{3,}", x) and (self.word(i + 1, j) or after == "("):
                to = self.close(i + 1, j) + 1 if after == "(" else i + 1
                if not self.word(to, j):
                    break
                i = to
            else:
                break
        return i, seen, test

    def declaration(self, i: int, j: int, up: Declaration | None) -> int | None:
        """Reads the declaration that starts at `i`; the place after it, or None if there is none."""
        start = i
        i, modifiers, test = self.prefix(i, j)
        if i >= j:
            return None
        w, g = self.word(i, j), self.g
        if w in g.through or self.text(i) == "{" and ("extern" in modifiers or i > start):
            at = self.head(i, j)
            if self.text(at) == "{":
                to = self.close(at, j)
                if not test:
                    self.scope(at + 1, to, up)
                return to + 1
            return None
        if test:
            return self.statement(i, j)
        if self.text(i) == "@" and self.text(i + 1) == "interface":
            return self.type_(start, i + 1, j, up, ("interface", "annotation"))
        if self.language == "zig" and w in ("const", "var"):
            return self.zig_container(start, i, j, up)
        if self.language == "go" and w == "type":
            return self.go_types(start, i + 1, j)
        if w == "using" and self.language == "cpp" and self.word(i + 1, j) and self.text(i + 2) == "=":
            to = self.statement(i, j)
            self.add("type_alias", "using", self.x[i + 1], start, to, up, i + 2)
            return to
        if w == "fun" and self.word(i + 1, j) == "interface":
            return self.type_(start, i + 1, j, up, ("interface", "interface"))
        if w in g.types and (to := self.type_(start, i, j, up, g.types[w])) is not None:
            return to
        if w in g.functions and (to := self.function(start, i, j, up)) is not None:
            return to
        if self.language in ("javascript", "typescript"):
            return self.js_member(start, i, j, up, modifiers)
        if up is not None and g.members or g.outside:
            return self.member(start, i, j, up, modifiers)
        return None

    def add(self, kind, node, name, start, end, up, head, body=0, **more) -> Declaration:
        d = Declaration(kind, node, name, start, min(end, self.n), up, min(head, self.n), body if body < self.n else 0, **more)
        self.found.append(d)
        return d

    # ---- types

    def type_(self, start: int, i: int, j: int, up, kind: tuple[str, str]) -> int | None:
        """A type whose word is at `i`."""
        w, n = self.x[i], i + 1
        if w == "enum" and self.word(n) in ("class", "struct"):
            n += 1
            kind = ("enum", "enum class")
        elif w == "record" and self.word(n) in ("class", "struct") and self.word(n + 1):
            kind = (self.x[n], self.x[n]) if self.x[n] == "struct" else kind
            n += 1
        elif w == "mixin" and self.word(n) == "class":
            return self.type_(start, n, j, up, ("class", "class"))
        elif w == "extension" and self.word(n) == "type":
            n += 1
        if w == "delegate":
            at = next((k for k in range(n, self.head(n, j)) if self.text(k) == "("), None)
            to = self.statement(i, j)
            if at is None or not self.word(at - 1):
                return None
            self.add("class", "delegate", self.x[at - 1], start, to, up, at)
            return to
        if w == "impl":
            return self.impl(start, n, j, up)
        trailing = ""
        if self.language in ("c", "cpp"):
            while self.word(n) and (self.word(n + 1) not in ("", "final") or self.text(n + 1) == "(" and self.text(self.close(n + 1, j) + 1) not in ("{", ";")):  # attributes before the name
                n = self.close(n + 1, j) + 1 if self.text(n + 1) == "(" else n + 1
            at = self.head(n, j)
            if self.text(at) != "{" or self.text(n + 1) in ("*", "&", "("):
                return None
            if not self.word(n):
                after = self.next(self.close(at, j) + 1, j)
                while self.text(after) == "*":
                    after += 1
                trailing = self.word(after)
                if not trailing:
                    return None
        name = trailing or self.word(n, j)
        if not name and w == "object" and "companion" in self.x[start:i]:
            name = "Companion"
            n -= 1
        if not name or name in ("extends", "implements", "{") or w in ("type", "record", "union", "object", "mixin", "extension") and self.text(n) in ("=", ":", "(", ".", ",", ")"):
            return None
        if w == "type" and self.text(self.t.angles(n + 1, j)) != "=":
            return None
        at = self.head(n + 1, j) if not trailing else self.head(n, j)
        if w == "type":
            to = self.statement(i, j)
            self.add(*kind, name, start, to, up, at)
            return to
        if w == "record" and self.language == "java" and "(" not in self.x[n + 1 : at]:
            return None
        body = self.text(at) == "{"
        end = self.close(at, j) + 1 if body else at + (self.text(at) == ";")
        if trailing:
            end = self.statement(end, j)
        d = self.add(*kind, name, start, end, up, at, at if body else 0)
        if (at > n + 1) and not trailing:
            d.bases = self.heritage(n + 1, at)
            opening = self.t.angles(n + 1, at)
            while opening < at and (self.text(opening) in ("private", "public", "internal", "protected", "constructor", "@") or self.k[opening] == "l"):
                opening += 1
            if self.text(opening) == "(":
                d.params = (opening + 1, self.close(opening, at))
        if body:
            self.scope(at + 1, self.close(at, j), d)
        return end

    def heritage(self, i: int, j: int) -> list[str]:
        """The bases in a type's head: names of the lists after words like extends, or after the colon."""
        out, listing = [], False
        while i < j:
            x = self.text(i)
            if x == "<" and (to := self.t.angles(i, j)) > i:
                i = to
                continue
            if x and x in "([":
                i = self.close(i, j) + 1
                continue
            if x in self.g.bases or x == ":" and self.g.colon:
                listing = True
            elif x == "where":
                break
            elif x in ("permits", "throws"):
                listing = False
            elif x == "by":  # what an item is delegated to
                while i < j and self.text(i) != ",":
                    i = (self.close(i, j) if self.text(i) in ("(", "[", "{") else i) + 1
            elif listing and self.k[i] == "w" and x not in ("public", "private", "protected", "virtual", "dyn", "final"):
                if x.startswith("'"):
                    i += 1
                    continue
                name, i = self.dotted(i, j)
                out.append(name.lstrip("\\"))
                continue
            i += 1
        return out

    def impl(self, start: int, i: int, j: int, up) -> int | None:
        """Methods of a type, and what it implements."""
        i = self.t.angles(i, j)
        at = self.head(i, j)
        if self.text(at) != "{":
            return None
        stop = next((k for k in range(i, at) if self.word(k) == "where"), at)
        split, k = None, i
        while k < stop:
            if self.text(k) == "<" and (to := self.t.angles(k, stop)) > k:
                k = to
                continue
            if self.word(k) == "for":
                split = k
            k += 1
        last = lambda a, b: next((self.x[q] for q in self._outer(a, b) if self.k[q] == "w" and not self.x[q].startswith("'") and self.text(q + 1) != "::" and self.x[q] not in ("dyn", "mut", "const")), "")
        name = last(split + 1 if split else i, stop)
        if not name:
            return None
        end = self.close(at, j) + 1
        d = self.add("impl", "impl", name, start, end, None, at, at)
        if split:
            trait = last(i, split)
            d.bases = [trait] if trait else []
        self.scope(at + 1, end - 1, d)
        return end

    def _outer(self, i: int, j: int):
        """Places that are in no angle brackets."""
        while i < j:
            if self.text(i) == "<" and (to := self.t.angles(i, j)) > i:
                i = to
                continue
            yield i
            i += 1

    def go_types(self, start: int, i: int, j: int) -> int | None:
        if self.text(i) == "(":
            to = self.close(i, j)
            k = i + 1
            while k < to:
                k = self.next(k, to)
                if k < to:
                    k = max(k + 1, self.go_type(k, k, to) or self.statement(k, to))
            return to + 1
        return self.go_type(start, i, j)

    def go_type(self, start: int, i: int, j: int) -> int | None:
        name, k = self.word(i, j), i + 1
        if not name:
            return None
        if self.text(k) == "[" and self.word(k + 1) and self.text(k + 2) not in ("]", ""):  # parameters of the type
            k = self.close(k, j) + 1
        w = self.word(k, j)
        if w in ("struct", "interface") and self.text(k + 1) == "{":
            end = self.close(k + 1, j) + 1
            self.add(w, w, name, start, end, None, k + 1, k + 1)
            return end
        end = self.statement(k, j)
        self.add("type_alias", "type", name, start, end, None, k)
        return end

    def zig_container(self, start: int, i: int, j: int, up) -> int | None:
        name, end = self.word(i + 1, j), self.statement(i, j)
        at = next((k for k in range(i + 2, min(end, i + 12)) if self.text(k) == "="), None)
        if not name or at is None:
            return None
        k = at + 1
        while self.word(k) in ("extern", "packed"):
            k += 1
        if self.word(k) not in ("struct", "enum", "union", "opaque"):
            return None
        body = self.head(k, end)
        if self.text(body) != "{":
            return None
        d = self.add("struct", "container", name, start, end, up, at, body)
        self.scope(body + 1, self.close(body, j), d)
        return end

    # ---- functions

    def function(self, start: int, i: int, j: int, up) -> int | None:
        """A function whose word is at `i`."""
        n, owner, receiver = i + 1, "", ""
        if self.language == "go" and self.text(n) == "(":
            to = self.close(n, j)
            words = [self.x[k] for k in range(n + 1, to) if self.k[k] == "w"]
            bracket = next((k for k in range(n + 1, to) if self.text(k) == "["), to)
            plain = [self.x[k] for k in range(n + 1, bracket) if self.k[k] == "w"]
            if not words:
                return None
            owner, receiver, n = plain[-1], plain[0] if len(plain) > 1 else "", to + 1
        while self.text(n) in ("*", "&"):
            n += 1
        n = self.t.angles(n, j) if self.text(n) == "<" else n
        if self.x[i] == "constructor":
            name, n = "constructor", i
        else:
            name = self.word(n, j)
            if self.language == "kotlin":  # a receiver before the name
                while True:
                    to = self.t.angles(n + 1, j)
                    to += self.text(to) == "?"
                    if self.text(to) != "." or not self.word(to + 1, j):
                        break
                    n = to + 1
                    name = self.x[n]
        if self.language == "scala" and not name and self.k[n] == "p" and self.text(n) not in ("(", "{", "["):
            name = self.x[n]
        if not name:
            return None
        k = self.t.angles(n + 1, j)
        if self.text(k) == "[" and self.language in ("go", "scala"):
            k = self.close(k, j) + 1
        params = (k + 1, self.close(k, j)) if self.text(k) == "(" else None
        if params is None and self.language != "scala":
            return None
        k = params[1] + 1 if params else k
        while self.language == "scala" and self.text(k) == "(":
            k = self.close(k, j) + 1
        at = self.head(k, j)
        if self.language == "go" and self.text(at) == "{" and self.word(at - 1) in ("interface", "struct"):  # a result type with a block of its own
            at = self.head(self.close(at, j) + 1, j)
        return self.body(start, at, j, up, name, params, "constructor" if name == "constructor" else self.x[i], owner=owner, receiver=receiver, head=k)

    def body(self, start, at, j, up, name, params, node, kind="function", owner="", receiver="", head=0) -> int:
        """Adds a function whose head ends at `at`; the place after it."""
        x = self.text(at)
        if x == "{":
            end = self.close(at, j) + 1
        elif x in ("=", "=>"):
            end = self.statement(at + 1, j)
        else:
            end = at + (x == ";")
        if up is not None and up.kind == "impl" and not owner:
            kind = "method"
        d = self.add(kind, node, name, start, max(end, start + 1), up, head or at, at if x in ("{", "=", "=>") else 0, params=params, owner=owner, receiver=receiver)
        if self.language == "zig" and x == "{":
            for k in range(at, end):
                if self.word(k) == "return" and self.word(k + 1) in ("struct", "enum", "union", "packed", "extern"):
                    inner = self.head(k + 1, end)
                    if self.text(inner) == "{":
                        d.kind, d.node = "struct", "generic"
                        self.scope(inner + 1, self.close(inner, end), d)
                    break
        elif x == "{" and kind != "enum":
            self.local_types(at + 1, end - 1, d)
        return end

    def local_types(self, i: int, j: int, up) -> None:
        """Types that a function declares."""
        k = i
        while k < j:
            w = self.word(k)
            if w in self.g.types and w not in ("type", "record", "object", "enum", "union", "mixin", "extension") and self.word(k + 1) and self.text(k - 1) in ("{", "}", ";", "\n", "abstract", "final", "static", "data"):
                to = self.type_(k, k, j, up, self.g.types[w])
                if to is not None:
                    k = to
                    continue
            k += 1

    def js_member(self, start, i, j, up, modifiers) -> int | None:
        """Functions in variables, and members of classes."""
        if self.word(i) in ("const", "let", "var"):
            name, k = self.word(i + 1, j), i + 2
            if not name:
                return None
            if self.text(k) == ":":
                k = self.to_equals(k, j)
            if self.text(k) == "=" and (params := self.arrow(k + 1, j)) is not None:
                end = self.statement(k + 1, j)
                self.add("function", "arrow", name, start, end, up, k, k, params=params)
                return end
            return None
        if up is None or up.kind != "class" or self.text(start - 1) in (".",):
            return None
        while self.word(i) in ("get", "set", "static", "async") and (self.word(i + 1) or self.text(i + 1) in ("*", "[")) or self.text(i) == "*":
            i += 1
        name, k = self.word(i, j), i + 1
        if not name or name in NOT_CALLS - {"in", "is", "as", "do", "catch", "match", "when", "lock", "using", "defined", "fn", "def", "func"}:
            return None
        while self.text(k) in ("?", "!"):
            k += 1
        k = self.t.angles(k, j)
        if self.text(k) == "(":
            at = self.head(self.close(k, j) + 1, j)
            if self.text(at) == "{":
                return self.body(start, at, j, up, name, (k + 1, self.close(k, j)), "method", "method", head=self.close(k, j) + 1)
            return None
        if self.text(k) == ":":
            k = self.to_equals(k, j)
        if self.text(k) == "=" and (params := self.arrow(k + 1, j)) is not None:
            end = self.statement(k + 1, j)
            self.add("method", "arrow field", name, start, end, up, k, k, params=params)
            return end
        return None

    def to_equals(self, i: int, j: int) -> int:
        """From a type's colon to the equals sign after it, past arrows in the type."""
        while i < j and self.text(i) not in ("=", ";", "}"):
            if self.k[i] == "l" and self.line_ends(i, j):
                return i
            x = self.text(i)
            i = self.close(i, j) + 1 if x and x in "([{" else max(i + 1, self.t.angles(i, j))
        return i

    def arrow(self, i: int, j: int) -> tuple[int, int] | None:
        """The parameters of a function value that starts at `i`."""
        i = self.next(i, j)
        if self.word(i) == "async":
            i += 1
        if self.word(i) == "function":
            k = i + 1
            while k < j and self.text(k) != "(":
                k += 1
            return k + 1, self.close(k, j)
        i = self.t.angles(i, j)
        if self.text(i) == "(":
            to = self.close(i, j)
            k = to + 1
            if self.text(k) == ":":
                while k < j and self.text(k) not in ("=>", ";", "}") and not (self.k[k] == "l" and self.line_ends(k, j)):
                    x = self.text(k)
                    k = self.close(k, j) + 1 if x and x in "([{" else max(k + 1, self.t.angles(k, j))
            return (i + 1, to) if self.text(k) == "=>" else None
        return (i, i + 1) if self.word(i) and self.text(i + 1) == "=>" else None

    def member(self, start, i, j, up, modifiers) -> int | None:
        """A function, or a property, whose type is written before its name."""
        k, name_at, lang = i, None, self.language
        k = self.t.angles(k, j) if lang in ("java", "dart") else k
        first = k
        while k < j:
            x = self.text(k)
            if self.k[k] in ("s", "n") or x in ("=", ";", "}", ")", "=>", "==") or x == "." and lang in ("c",):
                break
            if x == "(":
                name_at = k
                break
            if x == "{":
                break
            if x == "<" and (to := self.t.angles(k, j)) > k:
                k = to
                continue
            if x == "[":
                k = self.close(k, j)
            if x == "operator" and lang in ("cpp", "csharp", "dart"):
                at = next((q for q in range(k + 1, min(j, k + 5)) if self.text(q) == "(" and q > k + 1), None)
                if at is not None:
                    name_at, k = at, k
                    break
            if x == "get" and lang == "dart" and self.word(k + 1) and self.text(k + 2) in ("=>", "{", ";", "async", "sync"):
                at = self.head(k + 2, j)
                return self.body(start, at, j, up, self.x[k + 1], None, "getter", "method" if up else "function", head=k + 2) if self.text(at) != ";" else self.statement(i, j)
            k += 1
        if name_at is None:
            return self.property(start, first, k, j, up, modifiers) if lang == "csharp" else None
        n = name_at - 1
        if self.text(n) == ">" and lang in ("csharp", "dart", "cpp"):  # parameters of the function's type
            level = 0
            while n > first:
                level += (self.text(n) == ">") - (self.text(n) == "<")
                n -= 1
                if not level:
                    break
        name = self.word(n)
        if self.text(k) == "operator" and name_at > k:
            name, n = "operator" + "".join(self.x[k + 1 : name_at]), k
        if not name or name in NOT_CALLS or name in ("else", "template", "sizeof", "alignas", "decltype", "static_assert", "__attribute__", "defined"):
            return None
        if self.text(n - 1) == "~":
            name, n = "~" + name, n - 1
        while n - 2 >= first and self.text(n - 1) == "::" and (self.word(n - 2) or self.text(n - 2) == ">"):
            if self.text(n - 2) == ">":
                level, q = 0, n - 2
                while q > first:
                    level += (self.text(q) == ">") - (self.text(q) == "<")
                    if not level:
                        break
                    q -= 1
                q -= 1
            else:
                q = n - 2
            if not self.word(q):
                break
            name, n = f"{self.x[q]}::{name}", q
        if lang == "dart" and n - 2 >= first and self.text(n - 1) == "." and up is not None and self.word(n - 2) == up.name:
            name, n = f"{up.name}.{name}", n - 2
        if n > first and self.text(n - 1) in (".", "->", "?.", "=", "return", "new", "throw", "else", "await", "case", "goto", "delete", "using", "namespace"):
            return None
        constructor = n == first
        own = up.name if up is not None else ""
        parts = name.split("::")
        if constructor and lang != "c" and not (name.split(".")[0].lstrip("~") == own or len(parts) > 1 and parts[-1].lstrip("~") == parts[-2] or name.startswith("operator")):
            return None
        if constructor and lang == "c" and up is None and self.text(self.close(name_at, j) + 1) != "{":
            return None
        to = self.close(name_at, j)
        at = self.member_head(to + 1, j)
        x = self.text(at)
        if lang == "c" and x == ";" and self.words_only(name_at + 1, to) and at > to + 1:  # parameters declared after the brackets
            while self.text(at) == ";" and self.word(at + 1, j):
                at = self.head(at + 1, j)
            at += self.text(at) == ";" and self.text(at + 1) == "{"
            x = self.text(at)
        if x == "=" and lang in ("cpp",):
            return self.statement(at, j)
        if lang in ("java", "csharp") and up is not None:
            allowed = ("{", "=>", ";") if lang == "csharp" else ("{", ";")
            allowed = allowed if not constructor else ("{", "=>")
        elif lang == "dart":
            allowed = ("{", "=>", ";") if constructor else ("{", "=>")
        else:
            allowed = ("{",)
        if x not in allowed:
            return None
        kind = "method" if up is not None or "::" in name else "function"
        return self.body(start, at, j, up, name, (name_at + 1, to), "constructor" if constructor and up else "method" if up else "function", kind, head=to + 1)

    def member_head(self, i: int, j: int) -> int:
        """After a function's brackets: past what it throws, qualifiers, results and initialisers, to its block."""
        while i < j:
            x = self.text(i)
            if self.language in ("cpp", "dart", "csharp") and x == ":":
                i += 1
                while i < j:  # initialisers: name(...) or name{...}, and commas
                    _, at = self.dotted(i, j)
                    at = self.t.angles(at, j)
                    if at > i and self.text(at) in ("(", "{"):
                        i = self.close(at, j) + 1
                        if self.text(i) == ",":
                            i += 1
                            continue
                        break
                    if self.text(i) in ("{", ";", "=>"):
                        break
                    i += 1
                continue
            if x in ("{", ";", "=", "=>", "}", ",", ")"):
                return i
            if x and x in "([":
                i = self.close(i, j)
            elif x == "<" and (to := self.t.angles(i, j)) > i:
                i = to
                continue
            i += 1
        return j

    def words_only(self, i: int, j: int) -> bool:
        return j > i and all(self.k[k] == "w" or self.text(k) == "," for k in range(i, j))

    def property(self, start, first, k, j, up, modifiers) -> int | None:
        """A property with accessors or a value, public or nearly so."""
        if up is None or not modifiers & {"public", "protected", "internal"} or not self.word(k - 1) or k - 1 <= first:
            return None
        if self.text(k) == "{":
            inner = self.next(k + 1, j)
            while self.word(inner) in ("private", "protected", "internal", "public", "readonly") or self.text(inner) == "[":
                inner = self.close(inner, j) + 1 if self.text(inner) == "[" else inner + 1
            if self.word(inner) not in ("get", "set", "init"):
                return None
            end = self.close(k, j) + 1
            if self.text(end) == "=":
                end = self.statement(end, j)
        elif self.text(k) == "=>":
            end = self.statement(k + 1, j)
        else:
            return None
        self.add("variable", "property", self.x[k - 1], start, end, up, k, k)
        return end

    # ---- Ruby: blocks end with a word

    _OPENS = frozenset("if unless while until case for begin".split())

    def ruby(self, i: int, j: int, up) -> int:
        """Reads a scope from `i` on; the place of the `end` that closes it."""
        first, loop = True, False
        while i < j:
            w, x = self.word(i), self.text(i)
            if self.k[i] == "l" or x == ";":
                first, loop = True, False
                i += 1
                continue
            if w == "end" and self.text(i - 1) not in (".", "?."):
                return i
            if first and w in ("class", "module") and (self.word(i + 1) or self.text(i + 1) == "<"):
                name, k = self.dotted(i + 1, j)
                at, bases = k, []
                if self.text(k) == "<" and name:
                    base, at = self.dotted(k + 1, j)
                    bases = [base] if base else []
                if not name:  # class << self
                    to = self.ruby(self.line(k, j), j, up)
                else:
                    d = self.add("class", w, name, i, j, up, at, at, bases=bases)
                    to = self.ruby(at, j, d)
                    d.end = min(to + 1, j)
                i, first = to + 1, False
                continue
            if w == "def" and self.text(i - 1) not in (".",) and (self.word(i + 1) or self.k[min(i + 1, j - 1)] == "p"):
                k = i + 1
                if self.text(k + 1) == "." and self.word(k):
                    k += 2
                name = self.x[k] if k < j else ""
                k += 1
                if self.text(k) == "=" and self.t.at[k] == self.t.at[k - 1] + len(name) and self.text(k + 1) == "(" and self.k[k - 1] == "w":  # a setter
                    name, k = name + "=", k + 1
                elif self.k[k - 1] == "p":
                    while k < j and self.k[k] == "p" and self.text(k) != "(" and self.t.at[k] == self.t.at[k - 1] + len(self.x[k - 1]):
                        name, k = name + self.x[k], k + 1
                params = None
                if self.text(k) == "(":
                    params = (k + 1, self.close(k, j))
                    k = params[1] + 1
                d = self.add("function", "method", name, i, j, up, k, k, params=params)
                if self.text(k) == "=":
                    to = self.line(k, j)
                    d.end = to
                    i, first = to, True
                    continue
                to = self.ruby(k, j, d)
                d.end = min(to + 1, j)
                i, first = to + 1, False
                continue
            after_value = not first and self.text(i - 1) not in ("=", "(", "[", ",", "{", "|", "return", "&&", "||", "and", "or", "not", "!", "=>", "then", "do", "else", "<<", "+=")
            if w in self._OPENS and not (w != "begin" and w != "case" and w != "for" and after_value) and self.text(i - 1) not in (".", "?."):
                loop = w in ("while", "until", "for")
                to = self._ruby_block(i + 1, j, up, loop)
                i, first = to + 1, False
                continue
            if w == "do" and not loop:
                to = self.ruby(i + 1, j, up)
                i, first = to + 1, False
                continue
            first = w in ("then", "else", "ensure", "do", "begin", "private", "public", "protected", "private_class_method", "module_function")
            i += 1
        return j

    def _ruby_block(self, i: int, j: int, up, loop: bool) -> int:
        """The end of a block whose opening word came before `i`; the first `do` of a loop's line is its own."""
        if loop:
            k = i
            while k < j and self.k[k] != "l":
                if self.word(k) == "do":
                    return self.ruby(k + 1, j, up)
                k += 1
            return self.ruby(k, j, up)
        return self.ruby(i, j, up)

    def line(self, i: int, j: int) -> int:
        while i < j and not (self.k[i] == "l" and self.line_ends(i, j)) and self.text(i) != ";":
            x = self.text(i)
            i = self.close(i, j) + 1 if x and x in "([{" else i + 1
        return i


# ---- rows


def parameters(r: Reader, d: Declaration) -> list[str]:
    """The parameters as they are written."""
    if d.params is None:
        return []
    i, j = d.params
    out, begin, k = [], i, i
    while k < j:
        x = r.text(k)
        if x == ",":
            out.append((begin, k))
            begin = k + 1
        k = r.close(k, j) + 1 if x and x in "([{" else max(k + 1, r.t.angles(k, j))
    out.append((begin, j))
    cut = lambda a, b: r.t.source[r.t.at[a] : r.t.at[b] if b < r.n else len(r.t.source)].strip() if a < b else ""
    return [" ".join(x.split()) for a, b in out if (x := cut(a, b))]


def calls(r: Reader):
    """(place, relation, name) of calls and of what is made; a name after a call's brackets goes on as `a().b` (relation chain)."""
    i, n = 0, r.n
    access = ("::", "->") if r.language == "php" else (".", "::", "->") if r.language in ("c", "cpp") else (".", "?.", "::")
    ruby, taken = r.language == "ruby", {d.params[0] - 1 for d in r.found if d.params}
    while i < n:
        w = r.word(i)
        before = r.text(i - 1) if i else ""
        if not w or before in access and r.k[i - 1] == "p" or w in NOT_CALLS and w not in ("this", "self", "super", "new") or before == "\\" and r.word(i - 2):
            i += 1
            continue
        if w == "new" and r.word(i + 1) or w == "new" and r.text(i + 1) == "\\":
            name, k = r.dotted(i + 1, n)
            made = name.split(".")[-1].split("\\")[-1].split("::")[-1]
            constraint = r.text(i - 1) in (",", ":") and r.text(i + 1) == "("
            if made and (made[:1].isupper() or made[:1] == "_") and not constraint:
                yield i + 1, "new", name
            i = k
            continue
        if w == "new" or before == "@" or w == "pub" and r.language == "rust":
            i += 1
            continue
        name, k, at, relation = w, i + 1, i, "call"
        while True:
            while k + 1 < n and (r.text(k) in access or r.text(k) == "\\") and (r.word(k + 1) or r.text(k + 1) == "~" and r.word(k + 2)):
                name += (r.x[k] if r.x[k] in ("::", "\\") else ".") + r.x[k + 1]
                k += 2
            to = k
            if r.text(to) == "::" and r.text(to + 1) == "<":
                to += 1
            to = r.t.angles(to, n) if to < n and r.text(to) == "<" else to
            if r.text(to) == "!" and r.language in ("rust", "kotlin", "dart", "typescript") and r.text(to + 1) in ("(", "[", "{"):
                to += 1
            if ruby and name.endswith(".new"):
                made = name[: -len(".new")]
                if made[:1].isupper():
                    yield at, "new", made
                    if r.text(to) != "(":
                        break
            opens = r.text(to) == "(" or r.language == "rust" and to > k and r.text(to - 1) == "!" or r.text(to - 1) == "!" and r.text(to) in ("[", "{")
            if not opens or to in taken:
                break
            declared = relation == "call" and before and r.k[i - 1] == "w" and before not in _BEFORE_CALL and r.language not in ("ruby", "scala", "kotlin") and not r.x[i - 1][0] == "'"
            body = r.close(to, n) + 1
            if declared and (r.text(body) == "{" or r.language in ("java", "csharp", "dart", "c", "cpp")):
                break  # a name after a type, before brackets: declared here
            if before in (">", "]", "*", "&") and r.language in ("java", "csharp", "dart") and r.text(body) == "{" and before != "&":
                break
            yield at, relation, name
            if r.text(body) not in access or not r.word(body + 1):
                break
            name, k, relation = name + "()", body, "chain"
        i = i + 1 if k == i else max(i + 1, k if relation == "call" else i + 1)


def literals(r: Reader):
    """(place, name) of types whose values are written as a name and braces."""
    if r.language not in ("rust", "go", "zig"):
        return
    for i in range(r.n - 1):
        if r.text(i + 1) == "{" and r.word(i)[:1].isupper() or r.language == "go" and r.text(i + 1) == "[" and r.word(i)[:1].isupper() and r.text(r.close(i + 1, r.n) + 1) == "{":
            first = i
            while r.text(first - 1) in (".", "::") and r.word(first - 2):
                first -= 2
            before, d = r.text(first - 1), r.of[i]
            if d is None or d.kind in CONTAINERS and r.language != "zig" or i + 1 <= d.head or i + 1 == d.body or before in ("struct", "enum", "union", "trait", "impl", "for", "if", "while", "match", "in", "->", "+", "where", "mod", "fn", "interface", "map", "]") or before == ":" and r.language == "rust" and d.body and i < d.body:
                continue
            yield first, "".join(r.x[first : i + 1])


def _name_of_type(r: Reader, i: int, j: int) -> str:
    """The type that is written from `i` on: its first name, past references, wrappers and the like."""
    while i < j:
        x = r.text(i)
        if x in ("*", "&", "?", "[", "]", "mut", "const", "final", "dyn", "late", "static", "struct", "readonly", "ref", "in", "out", "volatile", "unsigned", "impl", "(") or r.k[i] == "n" or x.startswith("'"):
            i += 1
            continue
        name, k = r.dotted(i, j)
        short = re.split(r"\.|::|\\", name)[-1]
        if short in _WRAPPERS and r.text(k) in ("<", "["):
            i = k + 1
            continue
        return name
    return ""


def _inner_types(r: Reader, i: int, j: int):
    """(place, name) of the types in the angle brackets that open at `i`."""
    if r.text(i) != "<" or (to := r.t.angles(i, j)) == i:
        return
    k = i + 1
    while k < to:
        if r.word(k) and not r.x[k].startswith("'"):
            name, after = r.dotted(k, to)
            if _is_type(name, r.language):
                yield k, name
            k = max(after, k + 1)
        else:
            k += 1


def _is_type(name: str, language: str) -> bool:
    short = re.split(r"\.|::|\\", name)[-1]
    return bool(short) and (short[:1].isupper() or short[:1] == "_" and short[1:2].isupper()) and not (len(short) == 1)


def bindings(r: Reader):
    """(place, declaration, variable, type, how): what is known of variables' types; how is field, param, local or returns, or inner for a type that stands in another's brackets."""
    typed, n = r.g.typed if r.g else "", r.n
    how = lambda d, i: "field" if d.kind in CONTAINERS and not (d.params and d.params[0] <= i < d.params[1] and r.language not in ("kotlin", "scala", "java", "csharp")) else "param" if d.params and d.params[0] <= i < d.params[1] else "local"
    for d in r.found:  # what functions give back
        if d.params is None or d.kind in CONTAINERS:
            continue
        at = d.params[1] + 1
        stop = d.body if d.body > at else d.end
        name = ""
        if typed == "before" and r.language != "php":
            first, _, _ = r.prefix(d.start, d.params[0])
            first = r.t.angles(first, d.params[0])
            name = _name_of_type(r, first, d.params[0] - 1)
            name = "" if name == d.name else name
        elif typed == "go" or r.language == "zig":
            name = _name_of_type(r, at, stop) if at < stop else ""
        elif r.text(at) in (":", "->"):
            name = _name_of_type(r, at + 1, stop)
        if _is_type(name, r.language) or name in ("Self", "self", "static") or r.language == "c" and name and r.word(r.prefix(d.start, d.params[0])[0]) == "struct":
            yield at, d, "()", name, "returns"
        for k in range(at, min(stop, at + 40)) if typed != "before" else range(r.prefix(d.start, d.params[0])[0], d.params[0] - 1):
            if r.text(k) == "<":
                yield from ((q, d, "", inner, "inner") for q, inner in _inner_types(r, k, stop))
                break
    for i in range(n):
        d = r.of[i]
        w = r.word(i)
        if d is None or not w or w in NOT_CALLS and w not in ("this", "self"):
            continue
        before, after = r.text(i - 1), r.text(i + 1)
        if d.kind == "variable":
            d = d.up
        if d is None or i < max(d.body, d.head) and not (d.params and d.params[0] <= i < d.params[1]) and d.node not in ("arrow", "arrow field"):
            continue  # parameters of types, and what they are bound to
        # set to a value whose type is plain
        if after in ("=", ":=") and before not in (".", "->", "?.", "::") or after == "=" and r.text(i - 2) in ("this", "self", "$this") and before in (".", "->"):
            k = r.next(i + 2, n)
            while r.text(k) in ("&", "await", "const", "mut", "*", "try"):
                k += 1
            made = r.word(k) == "new"
            name, to = r.dotted(k + made, n)
            to = r.t.angles(to, n) if r.text(to) == "<" else to
            opens = r.text(to)
            own = "field" if r.text(i - 2) in ("this", "self", "$this") and before in (".", "->") or w[0] == "@" else how(d, i)
            if made and _is_type(name, r.language) or opens == "{" and r.language in ("go", "rust", "zig") and _is_type(name, r.language):
                yield i, d, w.lstrip("@"), name, own
                continue
            if opens == "(" and name and r.k[k] == "w":
                if re.search(r"(^|::|\.)new$", name) and r.language in ("ruby", "rust"):
                    name = re.sub(r"(::|\.)?new$", "", name)
                    if _is_type(name, r.language) or name == "Self":
                        yield i, d, w.lstrip("@"), name, own
                elif _is_type(name, r.language) and r.language in ("kotlin", "scala", "dart", "cpp"):
                    yield i, d, w.lstrip("@"), name, own
                elif not name.startswith(("this.", "self.")):
                    yield i, d, w.lstrip("@"), f"{name}()", own
        if typed == "after" and after in (":", "?", "!") and before not in ("?", "case", "::"):
            k = i + 1 + (after in ("?", "!"))
            if r.text(k) == ":" and (name := _name_of_type(r, k + 1, min(n, k + 12))) and _is_type(name, r.language):
                yield i, d, w, name, how(d, i)
                opens = next((q for q in range(k + 1, min(n, k + 12)) if r.text(q) in ("<", ",", ")", ";", "=", "}")), k)
                yield from ((q, d, "", inner, "inner") for q, inner in _inner_types(r, opens, n))
        elif typed == "before" and (i + 1 >= n or after in ("=", ";", ",", ")", "{", ":", "in", "=>") or r.k[i + 1] == "s") and (r.word(i - 1) or before in (">", "*", "&", "?", "]", "...")):
            k = i - 1
            while r.text(k) in ("*", "&", "?", "]", "[", "const", "final", "..."):
                k -= 1
            if r.text(k) == ">":
                level, begin = 0, k
                while k >= 0 and begin - k < 60:
                    level += (r.text(k) == ">") - (r.text(k) == "<")
                    k -= 1
                    if not level:
                        break
            last = k
            while r.text(k - 1) in (".", "::", "\\") and r.word(k - 2):
                k -= 2
            name = "".join(r.x[k : last + 1]) if r.word(last) else ""
            wrapped = re.split(r"\.|::", name)[-1] in _WRAPPERS and r.text(last + 1) == "<"
            name = _name_of_type(r, k, i) if wrapped else name
            plain = r.language != "c" or r.word(k - 1) == "struct" or name[:1].isupper()
            if (_is_type(name, r.language) or r.language == "c" and r.word(k - 1) == "struct") and plain and r.text(k - 1) not in (".", "new", "return", "throw", "extends", "class", "interface", "as", "is", "case", "instanceof", "goto", "enum"):
                yield k, d, w.lstrip("$"), name.lstrip("\\"), how(d, i)
                yield from ((q, d, "", inner, "inner") for q, inner in _inner_types(r, last + 1, n))
        elif typed == "go" and r.k[i] == "w" and before != "." and (d.kind == "struct" or d.params and d.params[0] <= i < d.params[1] or r.word(i - 1) == "var" or i < (d.body or 0)):
            k = i + 1
            while r.text(k) in ("*", "[", "]"):
                k += 1
            if d.kind == "struct" and (i <= d.head or not (r.k[i - 1] == "l" or before in ("{", ";", ","))) or k >= n or any(r.k[q] == "l" for q in range(i, k)):
                continue
            name, _ = r.dotted(k, n)
            if _is_type(name, r.language):
                yield i, d, w, name, how(d, i)


def embedded(r: Reader):
    """(place, struct, type) of fields without a name."""
    if r.language != "go":
        return
    for d in r.found:
        if d.kind != "struct" or not d.body:
            continue
        i, j = d.body + 1, d.end - 1
        while i < j:
            i = r.next(i, j)
            end = r.statement(i, j)
            k = i + (r.text(i) == "*")
            name, to = r.dotted(k, j)
            if to < j and r.text(to) == "[":
                to = r.close(to, j) + 1
            if name and (to >= j or r.k[to] in ("l", "s") or r.text(to) == ";"):
                yield k, d, name
            i = max(i + 1, end)
