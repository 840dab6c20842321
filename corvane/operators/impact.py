"""What a change of a name touches: every place that mentions it, and how."""

from __future__ import annotations

import ast
import io
import keyword
import re
import symtable
import tokenize

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvane.operators.search import is_test_path
from corvane.session import ship_package

# fixed values: endings, labels in order, how many lines of a section are shown, calls that take a name as a string
CONFIG = (".yml", ".yaml", ".toml", ".ini", ".cfg", ".json", ".env", ".properties")
PROSE = (".md", ".rst", ".txt")
COMMENT = re.compile(r"\s*(#|//|/?\*|--|<!--|;)")
ORDER = ("definition", "write", "keyword", "import", "attribute", "read")
CAPS = {"usage": 60, "default": 15}
DYNAMIC_CALLS = ("getattr", "setattr", "hasattr", "delattr")


class _Occurrences:
    """Walks the tokens of a module with its symbol tables: the tables say whose a name is, brackets and neighbours what is done with it."""

    def __init__(self, source: str, name: str):
        self.name, self.found = name, {}
        skipped = (tokenize.COMMENT, tokenize.NL, tokenize.ENCODING)
        self.t = [t for t in tokenize.generate_tokens(io.StringIO(source).readline) if t.type not in skipped]
        self.tables = [symtable.symtable(source, "module", "exec")]
        self.blocks: list[int] = []  # how deep each open function or class is indented
        self.open: list[dict] = []  # brackets
        self.indent = self.start = 0
        self.heads: list[tuple] = []  # functions and classes whose body comes
        self.walk()

    def put(self, kind: str, scope: str = "", line: int = 0) -> None:
        self.found.setdefault(line or self.t[self.i].start[0], set()).add((kind, scope))

    def at(self, i: int) -> str:
        return self.t[i].string if 0 <= i < len(self.t) else ""

    def own(self) -> bool:
        """Whether the name is, here, a function's own."""
        for table in reversed(self.tables[1:]):
            if table.get_type() == "function" and self.name in table.get_identifiers():
                symbol = table.lookup(self.name)
                return not symbol.is_global()
        return False

    def walk(self) -> None:
        for self.i, t in enumerate(self.t):
            s, bracket = t.string, self.open[-1] if self.open else None
            if t.type in (tokenize.INDENT, tokenize.DEDENT):
                self.start = self.i + 1
            if t.type == tokenize.INDENT:
                self.indent += 1
                if self.heads:
                    self.tables.append(self.heads.pop()[0])
                    self.blocks.append(self.indent)
            elif t.type == tokenize.DEDENT:
                if self.blocks and self.blocks[-1] == self.indent:
                    self.blocks.pop()
                    self.tables.pop()
                self.indent -= 1
            elif t.type == tokenize.NEWLINE:
                self.start = self.i + 1
                if self.heads and self.t[min(self.i + 1, len(self.t) - 1)].type != tokenize.INDENT:
                    self.heads.pop()  # a body in the line of its head
                    self.tables.pop()
            elif t.type == tokenize.OP and s in "([{":
                before = self.t[self.i - 1] if self.i else None
                value = before is not None and (before.type in (tokenize.STRING, tokenize.NAME) and not keyword.iskeyword(before.string) or before.string in (")", "]"))
                kind = "parameters" if self.heads and self.heads[-1][1] == self.i - 1 else s if not value else "call" if s == "(" else "index" if s == "[" else s
                self.open.append({"kind": kind, "of": before.string if before else "", "n": 0, "at": self.i})
            elif t.type == tokenize.OP and s in ")]}":
                if self.open:
                    self.open.pop()
            elif s == "," and bracket:
                bracket["n"] += 1
            elif s == ":" and self.heads and not self.open and self.heads[-1][1] >= 0:
                table, _ = self.heads.pop()
                self.heads.append((table, -1))
                if self.t[self.i + 1].type != tokenize.NEWLINE:
                    self.tables.append(table)
            elif t.type == tokenize.STRING:
                self.string(s, bracket)
            elif t.type == tokenize.NAME:
                if s in ("def", "class") and not self.open and self.t[self.i + 1].type == tokenize.NAME:
                    self.head()
                if s == self.name:
                    self.named(bracket)

    def head(self) -> None:
        name, line = self.at(self.i + 1), self.t[self.i].start[0]
        inner = [x for x in self.tables[-1].get_children() if x.get_name() == name]
        self.heads.append((next((x for x in inner if x.get_lineno() == line), inner[0] if inner else self.tables[-1]), self.i + 1))

    def string(self, s: str, bracket: dict | None) -> None:
        try:
            if ast.literal_eval(s) != self.name:
                return
        except (ValueError, SyntaxError):
            return
        after = self.at(self.i + 1)
        if bracket is None:
            return
        if bracket["kind"] == "index" and after == "]" or bracket["kind"] == "{" and after == ":" or bracket["kind"] == "call" and bracket["of"] in DYNAMIC_CALLS and bracket["n"] == 1:
            self.put("dynamic")
        elif bracket["kind"] in ("(", "[") and self.at(self.start) == "__all__":
            self.put("public")

    def named(self, bracket: dict | None) -> None:
        before, after, first = self.at(self.i - 1), self.at(self.i + 1), self.at(self.start)
        inside = bracket["kind"] if bracket else ""
        if first in ("import", "from"):
            if after != "." and not (first == "from" and before in ("from", ".") and "import" not in (t.string for t in self.t[self.start : self.i])):
                self.put("import")
        elif first in ("global", "nonlocal"):
            pass
        elif before in ("def", "class"):
            self.put("definition", "local" if self.own() else "")
        elif inside == "parameters" and before in ("(", ",", "*", "**") or self.lambda_parameter():
            self.put("definition", "parameter")
        elif before == ".":
            self.put("write" if self.stored(before, after, inside) else "attribute")
        elif inside == "call" and after == "=" and before in ("(", ","):
            self.put("keyword")
        else:
            scope = "local" if self.own() or self.of_comprehension() else ""
            top = not any(x.get_type() == "function" for x in self.tables)
            self.put("read" if not self.stored(before, after, inside) else "definition" if top else "write", scope)

    def lambda_parameter(self) -> bool:
        """Whether the place lies between `lambda` and its colon, as a name and not in a default."""
        i, depth = self.i - 1, 0
        if self.at(i) not in ("lambda", ",", "*", "**"):
            return False
        while i >= self.start and depth >= 0 and self.at(i) != "lambda":
            depth += (self.at(i) in (")", "]", "}")) - (self.at(i) in ("(", "[", "{"))
            if self.at(i) == ":" and not depth:
                return False
            i -= 1
        return self.at(i) == "lambda" and depth == 0

    def of_comprehension(self) -> bool:
        """Whether a comprehension around the place binds the name."""
        for bracket in self.open:
            depth, binding = 0, False
            for k in range(bracket["at"] + 1, len(self.t)):
                s = self.at(k)
                depth += (s in ("(", "[", "{")) - (s in (")", "]", "}"))
                if depth < 0:
                    break
                if not depth and s in ("for", "in"):
                    binding = s == "for"
                elif binding and s == self.name:
                    return True
        return False

    def stored(self, before: str, after: str, inside: str) -> bool:
        if before in ("for", "as", "del") or after == ":=":
            return True
        if inside in ("call", "index", "{", "parameters"):
            return False
        if not inside and (after == ":" and self.start == self.i or after in ("+=", "-=", "*=", "/=", "//=", "%=", "**=", "|=", "&=", "^=", ">>=", "<<=", "@=")):
            return True
        # a target: an equals sign follows outside of all brackets, or this is a loop's list of names
        depth, k, looped = len(self.open), self.i + 1, "for" in (t.string for t in self.t[self.start : self.i]) and "in" not in (t.string for t in self.t[self.start : self.i])
        if looped and before == ",":
            return True
        while k < len(self.t) and self.t[k].type != tokenize.NEWLINE:
            s = self.at(k)
            depth += (s in ("(", "[", "{")) - (s in (")", "]", "}"))
            if s == "=" and not depth:
                return self.at(self.i + 1) in ("=", ",", ")", "]")
            k += 1
        return False


def labelled(source: str, name: str) -> dict[int, tuple[str, str]]:
    """(kind, scope) by line of what Python code does with a name: definition, write, keyword, import, attribute, read; `other scope` where only a function's own name is meant.
    `dynamic` for the name as a string in getattr and the like (also as methods), as a key of a dict or an index; `public` in __all__. A line has the first of its labels in this order."""
    best = {}
    for line, found in _Occurrences(source, name).found.items():
        free = sorted((ORDER.index(k), s) for k, s in found if s != "local" and k in ORDER)
        apart = sorted(k for k, _ in found if k in ("dynamic", "public"))
        best[line] = (ORDER[free[0][0]], free[0][1]) if free else (apart[0] if apart else "other scope", "")
    return best


def parameters_of(source: str) -> list[str]:
    """Names of the parameters of a function's source, those that gather the rest included; also where it does not parse."""
    try:
        node = next(x for x in ast.walk(ast.parse(re.sub(r"^[ \t]+", "", source, count=1))) if isinstance(x, (ast.FunctionDef, ast.AsyncFunctionDef)))
        return [a.arg for a in sorted((x for x in ast.walk(node.args) if isinstance(x, ast.arg)), key=lambda a: (a.lineno, a.col_offset))]
    except (SyntaxError, StopIteration, ValueError):
        m = re.search(r"\(([^()]*(?:\([^()]*\)[^()]*)*)\)", source or "")
        return [w[0] for p in (m[1].split(",") if m else []) if (w := re.findall(r"[A-Za-z_$][\w$]*(?=\s*(?:[:=]|$))", p.strip()))]


def sites_in(path: str, text: str, name: str) -> list[tuple[int, str, str, str]]:
    """(line, kind, scope, text) of the lines of a file that hold the name as a whole identifier."""
    pattern = re.compile(rf"(?<![\w$]){re.escape(name)}(?![\w$])")
    if not text or name not in text:
        return []
    labels: dict[int, tuple[str, str]] = {}
    comments: set[int] = set()
    if path.endswith(".py"):
        try:
            labels = labelled(text, name)
            code = {t.start[0] for t in tokenize.generate_tokens(io.StringIO(text).readline) if t.type == tokenize.NAME and t.string == name}
            comments = set(range(1, text.count("\n") + 2)) - code - set(labels)
        except (SyntaxError, ValueError, RecursionError, tokenize.TokenError):
            pass
    out = []
    for i, line in enumerate(text.split("\n"), 1):
        if not pattern.search(line):
            continue
        if i in labels:
            kind, scope = labels[i]
        elif path.endswith(PROSE) or COMMENT.match(line) or i in comments:
            kind, scope = "textual", ""
        else:
            kind, scope = ("config" if path.endswith(CONFIG) else "reference"), ""
        out.append((i, kind, scope, line.strip()[:200]))
    return out


def sites(files: DataFrame, name: str) -> DataFrame:
    """path, line, kind, scope, text and is_test of every mention of a name in `files` (path, text); files without it are left out by the scan."""
    ship_package(files.sparkSession)

    def run(frames):
        import pandas as pd

        for frame in frames:
            rows = [(p, *s) for p, t in zip(frame["path"], frame["text"]) for s in sites_in(p, t, name)]
            yield pd.DataFrame(rows, columns=["path", "line", "kind", "scope", "text"])

    return files.filter(F.contains("text", F.lit(name))).select("path", "text").mapInPandas(run, "path string, line int, kind string, scope string, text string").withColumn("is_test", is_test_path(F.col("path")))


def innermost(lines: DataFrame, components: DataFrame) -> DataFrame:
    """`lines` (path, line) with the id of the smallest component around each, the first stored on ties."""
    inside = lines.select("path", "line").distinct().join(components.select("id", F.col("relative_path").alias("path"), "start_line", "end_line"), "path").filter("line BETWEEN start_line AND end_line")
    best = inside.groupBy("path", "line").agg(F.min(F.struct((F.col("end_line") - F.col("start_line")).alias("size"), "start_line", "id")).alias("b")).select("path", "line", F.col("b.id").alias("id"))
    return lines.join(best, ["path", "line"], "left")


def is_parameter(name: str, found: DataFrame, components: DataFrame) -> DataFrame:
    """id of the functions that have a name as a parameter, where no other definition of it is found."""
    defined = F.broadcast(found.filter("kind = 'definition' AND scope = ''").limit(1).select(F.lit(True).alias("_defined")))
    return components.filter(F.array_contains("parameters", name)).join(defined, F.lit(True), "left").filter("_defined IS NULL").select("id")


def callers(seeds: DataFrame, edges: DataFrame, hops: int = 2) -> DataFrame:
    """id, hop and via: what uses the seeds (id) within `hops` steps, in the order it is found."""
    seen = seeds.select("id", F.lit(0).alias("hop"), F.lit(None).cast("string").alias("via")).distinct()
    level = seen
    for hop in range(1, hops + 1):
        step = level.select(F.col("id").alias("dst")).join(edges, "dst").groupBy(F.col("src").alias("id")).agg(F.min("dst").alias("via")).withColumn("hop", F.lit(hop)).select("id", "hop", "via")
        level = step.join(seen.select("id"), "id", "left_anti")
        seen = seen.unionByName(level)
    return seen.filter("hop > 0")


def report(name: str, files: DataFrame, components: DataFrame, edges: DataFrame, sections: DataFrame) -> DataFrame:
    """section, path, line, kind, text and id: definitions, usages, places of the name in text, other scopes, dynamic and public access, tests, pages (sections: file, anchor, content) and callers two steps away."""
    found = innermost(sites(files, name), components)
    section = F.when(F.col("kind") == "definition", "definitions").when(F.col("kind") == "other scope", "other scope").when(F.col("kind").isin("dynamic", "public", "textual", "config"), F.col("kind")).otherwise("usages")
    rows = found.select(section.alias("section"), "path", "line", "kind", "text", "id")
    tests = found.filter("is_test").select(F.lit("tests").alias("section"), "path", F.lit(None).cast("int").alias("line"), F.lit("test").alias("kind"), F.lit("").alias("text"), F.lit(None).cast("string").alias("id")).distinct()
    docs = sections.filter(F.col("content").rlike(rf"(?<![\w$])\Q{name}\E(?![\w$])")).select(F.lit("docs").alias("section"), F.col("file").alias("path"), F.lit(None).cast("int").alias("line"), F.lit("page").alias("kind"), F.col("anchor").alias("text"), F.lit(None).cast("string").alias("id"))
    seeds = found.filter("id IS NOT NULL AND kind NOT IN ('other scope', 'textual') AND NOT is_test").select("id").distinct()
    used = callers(seeds, edges).select(F.lit("callers").alias("section"), F.substring_index("id", "::", 1).alias("path"), F.lit(None).cast("int").alias("line"), F.concat(F.lit("hop "), F.col("hop").cast("string")).alias("kind"), F.col("via").alias("text"), "id")
    return rows.unionByName(tests).unionByName(docs).unionByName(used)


def rendered(rows: DataFrame) -> DataFrame:
    """section, ord and line: a report in lines, 60 usages and 15 of each other section, then how many more there are."""
    most = F.when(F.col("section") == "usages", CAPS["usage"]).otherwise(CAPS["default"])
    nth = Window.partitionBy("section").orderBy("path", "line", "text")
    # no more than the largest cap of a section leaves a task, and the others are only counted
    ranked = rows.withColumn("ord", F.row_number().over(nth)).filter(F.col("ord") <= max(CAPS.values()))
    shown = ranked.filter(F.col("ord") <= most).select("section", "ord", F.concat(F.col("path"), F.coalesce(F.concat(F.lit(":"), F.col("line").cast("string")), F.lit("")), F.lit(" "), F.col("kind"), F.lit(" "), F.coalesce("text", F.lit(""))).alias("line"))
    more = rows.groupBy("section").agg(F.count("*").alias("n")).withColumn("most", most).filter("n > most").select("section", (F.col("most") + 1).alias("ord"), F.concat(F.lit("... "), (F.col("n") - F.col("most")).cast("string"), F.lit(" more")).alias("line"))
    return shown.unionByName(more)
