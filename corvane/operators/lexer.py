"""Tokens of source files: a lexer with a stack of modes, by tables of a language's comments and strings.

Code, strings and the holes in strings (`${...}`, `#{...}`, `{...}`) are modes; a hole is code again, so calls in templates are seen, and quotes or braces in comments, raw
strings, here-documents or regular expressions are not. Nothing is lost by an unclosed string: a one-line string ends with its line.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from dataclasses import dataclass
from functools import lru_cache


@dataclass(frozen=True)
class Quote:
    """A kind of string: how it opens (a pattern; its group `d` is a part of the closing), how it closes, whether a backslash escapes, how a hole opens, whether it may pass a line's end, and what stands for a quote doubled."""

    opens: str
    closes: str
    escapes: bool = True
    hole: str = ""
    lines: bool = False
    doubled: str = ""


DOUBLE, SINGLE = Quote('"', '"'), Quote("'", "'")
CHAR = Quote(r"'(?=(?:\\[^\n]+?|[^\\\n'])')", "'")
TRIPLE = Quote('"""', '"""', lines=True)
TEMPLATE = Quote("`", "`", hole="${", lines=True)


@dataclass(frozen=True)
class Lexicon:
    quotes: tuple[Quote, ...] = (DOUBLE, SINGLE)
    line: str = "//"
    block: tuple[str, str] | None = ("/*", "*/")
    nested: bool = False
    newlines: bool = False
    #: Lines that start with # are not code, with those that they go on in.
    directives: bool = False
    #: A slash where no value stands before opens a regular expression.
    regexes: bool = False
    #: Here-documents, whose text starts in the next line.
    heredocs: bool = False
    #: How code begins and ends in a text that is none.
    island: tuple[str, str] | None = None
    word: str = r"[^\W\d][\w]*"


LEXICONS = {
    "javascript": Lexicon((DOUBLE, SINGLE, TEMPLATE), newlines=True, regexes=True, word=r"[#$@]?[^\W\d][\w$]*|\$[\w$]*"),
    "java": Lexicon((TRIPLE, DOUBLE, SINGLE), word=r"[^\W\d$][\w$]*"),
    "csharp": Lexicon((
        Quote(r'\$*(?P<d>"{3,})', "", escapes=False, lines=True), Quote(r'(?:\$@|@\$)"', '"', escapes=False, hole="{", lines=True, doubled='""'), Quote('@"', '"', escapes=False, lines=True, doubled='""'), Quote(r'\$"', '"', hole="{"), DOUBLE, SINGLE,
    ), directives=True, word=r"@?[^\W\d]\w*"),
    "c": Lexicon((DOUBLE, SINGLE), directives=True),
    "cpp": Lexicon((Quote(r'(?:u8|[uUL])?R"(?P<d>[^\s()\\]{0,16})\(', ')', escapes=False, lines=True), DOUBLE, Quote(r"(?<!\w)'", "'")), directives=True),
    "kotlin": Lexicon((Quote('"""', '"""', escapes=False, hole="${", lines=True), Quote('"', '"', hole="${"), SINGLE), nested=True, newlines=True),
    "php": Lexicon((Quote(r"<<<[ \t]*'(?P<d>\w+)'", "\n", escapes=False, lines=True), Quote(r'<<<[ \t]*"?(?P<d>\w+)"?', "\n", hole="{$", lines=True), Quote('"', '"', hole="{$", lines=True), Quote("'", "'", lines=True)), line=r"(?://|#(?!\[))(?:(?!\?>)[^\n])*", island=(r"<\?(?:php\b|=)?", "?>"), word=r"\$?[^\W\d]\w*|\\(?=\w)"),
    "ruby": Lexicon((Quote('"', '"', hole="#{", lines=True), Quote("'", "'", lines=True), Quote("`", "`", hole="#{", lines=True), Quote(r"%[qQwWiIrsx]?(?P<d>[(\[{<|!/])", "", lines=True)), line="#", block=None, newlines=True, regexes=True, heredocs=True, word=r"@{0,2}[^\W\d]\w*(?:[?!](?!=[^=>~]))?|:[^\W\d]\w*[?!]?(?!:)"),
    "scala": Lexicon((Quote(r'[a-z]\w*"""', '"""', escapes=False, hole="${", lines=True), Quote('"""', '"""', escapes=False, lines=True), Quote(r'[a-z]\w*"', '"', hole="${"), DOUBLE, CHAR), nested=True, newlines=True),
    "rust": Lexicon((Quote(r'b?r(?P<d>#*)"', '"', escapes=False, lines=True), Quote('b?"', '"', lines=True), CHAR), nested=True, word=r"'?[^\W\d]\w*"),
    "dart": Lexicon((Quote("r'''", "'''", escapes=False, lines=True), Quote('r"""', '"""', escapes=False, lines=True), Quote("r'", "'", escapes=False), Quote('r"', '"', escapes=False), Quote("'''", "'''", hole="${", lines=True), Quote('"""', '"""', hole="${", lines=True), Quote("'", "'", hole="${"), Quote('"', '"', hole="${")), nested=True, word=r"[^\W\d][\w$]*|\$\w+"),
    "go": Lexicon((DOUBLE, Quote("`", "`", escapes=False, lines=True), SINGLE), newlines=True),
    "zig": Lexicon((DOUBLE, SINGLE, Quote(r"\\\\", "\n", escapes=False)), block=None, word=r"@?[^\W\d]\w*"),
}
LEXICONS["typescript"] = LEXICONS["javascript"]
_PAIRS = {"(": ")", "[": "]", "{": "}", "<": ">"}
_MARKS = r"::|->|=>|\?\.|:=|&&|\|\||==|!=|<=|\.\.\.?|[^\w\s]"
#: What a regular expression may follow, besides the start.
_BEFORE_REGEX = set("( [ { , ; : = == != ! && || ? + - * % & | => < return case typeof in of when if unless and or not elsif while \n".split(" "))


@lru_cache
def _code(lexicon: Lexicon) -> tuple[re.Pattern, dict[str, Quote]]:
    """One pattern for what may stand next in code, and the quotes by the names of their groups."""
    quotes, parts = {f"q{i}": q for i, q in enumerate(lexicon.quotes)}, []
    if lexicon.directives:
        parts.append(r"(?P<directive>(?:^|(?<=\n))[ \t]*\#(?:\\\r?\n|/\*(?:[^*]|\*(?!/))*\*/|[^\n])*)")
    if lexicon.island:
        parts.append(f"(?P<leave>{re.escape(lexicon.island[1])})")
    if lexicon.heredocs:
        parts += [r"(?P<pod>(?:^|(?<=\n))=begin\b(?:.|\n)*?(?:\n=end\b[^\n]*|\Z))", r"(?P<here><<[~-]?(?P<hq>['\"`]?)(?P<hd>[A-Z_]\w*)(?P=hq))"]
    if lexicon.block:
        parts.append(rf"(?P<block>{re.escape(lexicon.block[0])})")
    if lexicon.line:
        parts.append(f"(?P<line>{lexicon.line})" if lexicon.island else rf"(?P<line>(?:{lexicon.line})[^\n]*)")
    parts += [f"(?P<{k}>{q.opens.replace('(?P<d>', f'(?P<{k}d>')})" for k, q in quotes.items()]
    parts += [rf"(?P<word>{lexicon.word})", r"(?P<number>\d[\w]*(?:\.\d\w*)?)", r"(?P<nl>\n)", r"(?P<space>\s+?)", rf"(?P<mark>{_MARKS})"]
    return re.compile("|".join(parts)), quotes


@lru_cache(4096)
def _inside(quote: Quote, closes: str) -> re.Pattern:
    """What matters inside a string: escapes, doubled quotes, holes, the end."""
    parts = [r"(?P<escape>\\(?:.|\n))"] if quote.escapes else []
    if quote.doubled:
        parts.append(f"(?P<doubled>{re.escape(quote.doubled)})")
    if quote.hole:
        if quote.hole == "{":
            parts.append(r"(?P<two>\{\{)")
        parts.append(f"(?P<hole>{re.escape(quote.hole)})")
    parts.append(f"(?P<close>{closes})")
    if not quote.lines and closes != r"\n":
        parts.append(r"(?P<end>\n)")
    return re.compile("|".join(parts))


class Tokens:
    """kind (w word, n number, s string, p mark, l line's end), text and offset of each token; `pair` has the other end of each bracket."""

    def __init__(self, text: str, lexicon: Lexicon):
        self.source, self.kind, self.text, self.at, self.comments = text, [], [], [], []
        self._read(text, lexicon)
        self.pair = self._pairs()
        self._lines = [m.start() for m in re.finditer("\n", text)]

    def _add(self, kind: str, text: str, at: int) -> None:
        self.kind.append(kind)
        self.text.append(text)
        self.at.append(at)

    def _read(self, text: str, lexicon: Lexicon) -> None:
        code, quotes = _code(lexicon)
        modes: list = []  # strings that are open, and the depth of braces at each of their holes
        depth, i, n, pending = 0, 0, len(text), []
        if lexicon.island and (m := re.search(lexicon.island[0], text)):
            i = m.end()
        while i < n:
            if modes and isinstance(modes[-1], tuple):
                quote, closes = modes[-1]
                m = _inside(quote, closes).search(text, i)
                if m is None:
                    return
                i = m.end()
                if m.lastgroup in ("close", "end"):
                    modes.pop()
                    if m.lastgroup == "end" or closes == r"\n":
                        i = m.start()
                elif m.lastgroup == "hole":
                    modes.append(depth)
                    if quote.hole == "{$":
                        i -= 1
                continue
            m = code.match(text, i)
            if m is None:
                i += 1
                continue
            kind, at, i = next(k for k, v in m.groupdict().items() if v is not None and k not in ("hq", "hd")), i, m.end()
            if kind == "leave":
                m = re.compile(lexicon.island[0]).search(text, i)
                self._add("p", ";", at)
                i = m.end() if m else n
            elif kind in quotes:
                quote = quotes[kind]
                self._add("s", m[0], at)
                given = m.groupdict().get(f"{kind}d")
                closes = re.escape(quote.closes)
                if given is not None:
                    if quote.closes == "\n":  # a here-document that opens at its own line
                        closes = rf"\n[ \t]*{given}\b"
                    elif quote.closes == ")":
                        closes = re.escape(f'){given}"')
                    elif quote.closes:
                        closes = re.escape(quote.closes + given)
                    else:
                        closes = re.escape(_PAIRS.get(given, given))
                modes.append((quote, r"\n" if quote.closes == "\n" and given is None else closes))
            elif kind == "here":
                pending.append(m["hd"])
                self._add("s", m[0], at)
            elif kind in ("block", "line", "directive", "pod"):
                if kind == "block":
                    i = self._after_block(text, i, lexicon)
                self.comments.append((at, i))
            elif kind == "mark" and m[0] == "/" and lexicon.regexes and (not self.text or self.text[-1] in _BEFORE_REGEX):
                body = re.compile(r"(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/\w*").match(text, i)
                if body:
                    self._add("s", "/", at)
                    i = body.end()
                else:
                    self._add("p", "/", at)
            elif kind == "nl":
                if lexicon.newlines:
                    self._add("l", "\n", at)
                for name in pending:
                    end = re.compile(rf"^[ \t]*{name}[ \t]*$", re.M).search(text, i)
                    i = end.end() if end else n
                pending = []
            elif kind != "space":
                if m[0] == "{":
                    depth += 1
                elif m[0] == "}":
                    if modes and modes[-1] == depth:
                        modes.pop()
                        continue
                    depth -= 1
                self._add({"word": "w", "number": "n", "mark": "p"}[kind], m[0], at)

    @staticmethod
    def _after_block(text: str, i: int, lexicon: Lexicon) -> int:
        opens, closes = lexicon.block
        level = 1
        for m in re.compile(f"{re.escape(opens)}|{re.escape(closes)}").finditer(text, i):
            level += (m[0] == opens) * lexicon.nested - (m[0] == closes)
            if not level:
                return m.end()
        return len(text)

    def _pairs(self) -> dict[int, int]:
        out, open_ = {}, []
        for i, (kind, x) in enumerate(zip(self.kind, self.text)):
            if kind != "p":
                continue
            if x in "([{":
                open_.append(i)
            elif x in ")]}":
                while open_ and _PAIRS[self.text[open_[-1]]] != x:
                    if x != "}" and self.text[open_[-1]] == "{":
                        break  # a stray closing mark does not end a block
                    out[open_.pop()] = i
                if open_ and _PAIRS[self.text[open_[-1]]] == x:
                    out[i], out[open_[-1]] = open_[-1], i
                    open_.pop()
        for i in open_:
            out[i] = len(self.kind)
        return out

    def __len__(self) -> int:
        return len(self.kind)

    def line(self, offset: int) -> int:
        return bisect_right(self._lines, offset - 1) + 1

    def angles(self, i: int, end: int) -> int:
        """The place after the angle brackets that open at `i`; `i` itself if they are none."""
        if i >= end or self.text[i] != "<":
            return i
        level, j = 0, i
        while j < end:
            x = self.text[j]
            if x == "<":
                level += 1
            elif x == ">":
                level -= 1
                if not level:
                    return j + 1
            elif x in "([":
                j = self.pair.get(j, end)
            elif x in (";", "{", "}", ")", "]", "&&", "||") or self.kind[j] == "s" and x == "/":
                return i
            j += 1
        return i


def tokens(text: str, language: str) -> Tokens:
    return Tokens(text, LEXICONS[language])
