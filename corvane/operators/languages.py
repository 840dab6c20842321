"""Components and calls of source files in sixteen languages.

Python is read with its own parser; the others by a lexer with modes (`lexer`) and one reader of scopes over tables of a language's words (`declarations`). Each call and each variable
whose type is known belongs to the innermost declaration around it. What names stand for is left to joins (`resolve`). A file that yields nothing, or does not parse, is one component of type file: extraction never loses a file.
"""

from __future__ import annotations

import ast
import builtins
import re
import sys

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.operators.declarations import CONTAINERS, Reader, bindings, calls, embedded, literals, parameters
from corvane.operators.lexer import LEXICONS
from corvane.session import ship_package

SCHEMA = (
    "row_kind string, path string, language string, id string, component_type string, node_type string, name string, start_line int, end_line int, source_code string, docstring string, "
    "parameters array<string>, base_classes array<string>, callee string, relation string, call_line int"
)
COLUMNS = [c.split()[0] for c in SCHEMA.split(", ")]

# fixed values: the language of a file by its ending
EXTENSIONS = {
    "py": "python", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript", "ts": "typescript", "tsx": "typescript", "mts": "typescript", "cts": "typescript",
    "java": "java", "cs": "csharp", "c": "c", "h": "c", "cpp": "cpp", "cc": "cpp", "cxx": "cpp", "hpp": "cpp", "hh": "cpp", "hxx": "cpp",
    "kt": "kotlin", "kts": "kotlin", "php": "php", "rb": "ruby", "scala": "scala", "sc": "scala", "rs": "rust", "dart": "dart", "go": "go", "zig": "zig", "vue": "vue",
}

_SELVES = ("this", "self", "Self", "$this", "static", "@")
#: Languages in which the body of a type has declarations only; what looks like a call there is one.
_NO_CALLS_IN_TYPES = ("c", "cpp")


def scanned(path: str, text: str, language: str) -> list[dict]:
    """Components, calls and the types of variables of one file."""
    r = Reader(text, language)
    t = r.t
    blank = dict.fromkeys(COLUMNS) | {"path": path, "language": language}
    begin = lambda i: t.at[i] if i < r.n else len(text)
    line = lambda i: t.line(begin(i))
    rows, known = [], set()
    for d in r.found:
        d.id = f"{path}::{d.path()}" + ("$" if language == "scala" and d.node == "object" else "")
    for d in sorted(r.found, key=lambda d: (d.start, -d.end)):
        if d.kind != "impl" and d.id not in known:
            known.add(d.id)
            member = d.owner or d.up is not None and d.up.kind in CONTAINERS or "::" in d.name
            kind = "method" if d.kind == "function" and member else d.kind
            last = d.end - 1
            to = begin(last) + len(t.text[last]) if t.kind[last] != "s" else begin(d.end)
            source = text[begin(d.start) : to].rstrip()
            before = re.search(r"(?:/\*\*(?:[^*]|\*(?!/))*\*/|(?:(?://[/!]?|#)[^\n]*\n[ \t]*)+)\s*\Z", text[: begin(d.start)])
            doc = re.sub(r"^[ \t]*(?:/\*\*|\*/|\*|//[/!]?|#)[ \t]?", "", before[0], flags=re.M).replace("*/", "").strip() if before else None
            rows.append(blank | {"row_kind": "component", "id": d.id, "component_type": kind, "node_type": d.node, "name": d.name.split("::")[-1], "start_line": line(d.start), "end_line": t.line(begin(d.start) + max(0, len(source) - 1)), "source_code": source, "docstring": doc or None, "parameters": parameters(r, d) if kind in ("function", "method") else None, "base_classes": d.bases or None})
        rows += [blank | {"row_kind": "call", "id": d.id, "callee": b, "relation": "inherits", "call_line": line(d.start)} for b in d.bases]

    def called(i: int, relation: str, callee: str) -> None:
        d = r.of[i]
        if d is None or relation in ("call", "chain") and (d.kind == "interface" or d.kind in CONTAINERS and language in _NO_CALLS_IN_TYPES):
            return
        callee = callee.lstrip("\\")
        head = re.match(r"[^.:(]*", callee)[0]
        owner = d.owner or (d.up.name if d.up is not None else d.name if d.kind in CONTAINERS else "")
        if owner and (head in _SELVES or d.receiver and head == d.receiver):
            callee = re.sub(r"^[^.:(]+(?:\.|::)", f"{owner}.", callee)
        rows.append(blank | {"row_kind": "call", "id": d.id, "callee": callee, "relation": relation, "call_line": line(i)})

    for i, relation, callee in calls(r):
        called(i, relation, callee)
        if language == "php" and relation == "call" and "::" in callee and callee[:1].isupper():
            called(i, "static", callee.split("::")[0])
    for i, name in literals(r):
        called(i, "new", name)
    for i, d, name in embedded(r):
        called(i, "embeds", name)
    for i in range(r.n):
        w = r.word(i)
        if language == "ruby" and w in ("include", "extend", "prepend") and r.word(i + 1)[:1].isupper() or language == "php" and w == "use" and r.of[i] is not None and r.of[i].kind in CONTAINERS:
            k = i + 1
            while r.word(k) or r.text(k) == "\\":
                name, k = r.dotted(k, r.n)
                called(i, "mixin" if language == "ruby" else "uses", name)
                k += r.text(k) == ","
    for i, d, name, kind, how in bindings(r):
        if how == "inner":
            called(i, "type", kind)
            continue
        if kind in ("Self", "self", "static"):
            kind = d.owner or (d.up.name if d.up is not None else kind)
        if how == "field" and d.kind not in CONTAINERS:  # this.x = ... in a method
            where = f"{path}::{d.owner}" if d.owner else d.up.id if d.up is not None else d.id
        else:
            where = d.id
        rows.append(blank | {"row_kind": "binding", "id": where, "name": name, "callee": kind, "relation": how, "call_line": line(i)})
        if not kind.endswith("()"):
            called(i, "type", kind)
    return rows


def vue(path: str, text: str) -> list[dict]:
    """A single-file component: its scripts as they stand (lines stay), option members, and the tags that its template uses."""
    whole = re.sub(r"[^\n]", " ", text)
    kept, language = list(whole), "javascript"
    for m in re.finditer(r"<script\b([^>]*)>(.*?)</script>", text, re.S):
        kept[m.start(2) : m.end(2)] = m[2]
        if re.search(r"""lang=["']tsx?["']""", m[1]):
            language = "typescript"
    name = re.sub(r"\.vue$", "", path.rsplit("/", 1)[-1])
    own = f"{path}::{name}"
    blank = dict.fromkeys(COLUMNS) | {"path": path, "language": "vue"}
    rows = [blank | {"row_kind": "component", "id": own, "component_type": "class", "node_type": "component", "name": name, "start_line": 1, "end_line": text.count("\n") + 1, "source_code": text}]
    script = "".join(kept)
    rows += [r | {"language": "vue"} for r in scanned(path, script, language)]
    r = Reader(script, language)
    for i in range(r.n - 2):
        if r.word(i) not in ("methods", "computed", "watch") or r.text(i + 1) != ":" or r.text(i + 2) != "{":
            continue
        k, end = i + 3, r.close(i + 2, r.n)
        while k < end:  # an entry after the other
            k = r.next(k, end)
            k += r.word(k, end) == "async" and r.word(k + 1, end) != ""
            name, after = r.word(k, end), k + 1
            function = r.text(after) == "(" and r.text(r.close(after, end) + 1) == "{" or r.text(after) == ":" and r.arrow(after + 1, end) is not None
            stop = k
            while stop < end and r.text(stop) != ",":
                x = r.text(stop)
                stop = (r.close(stop, end) if x and x in "([{" else stop) + 1
            if name and function:
                first, last = r.t.line(r.t.at[k]), r.t.line(r.t.at[min(stop, end) - 1])
                rows.append(blank | {"row_kind": "component", "id": f"{own}.{name}", "component_type": "method", "node_type": "option", "name": name, "start_line": first, "end_line": last})
            k = stop + 1
    if t := re.search(r"<template\b[^>]*>(.*)</template>", text, re.S):
        for m in re.finditer(r"<([A-Z]\w*|[a-z]+(?:-[a-z0-9]+)+)\b", t[1]):
            tag = "".join(x[:1].upper() + x[1:] for x in m[1].split("-"))
            rows.append(blank | {"row_kind": "call", "id": own, "callee": tag, "relation": "tag", "call_line": text.count("\n", 0, t.start(1) + m.start(1)) + 1})
    return rows


def python(path: str, text: str) -> list[dict]:
    """Classes, functions and methods; calls, bases and imports. Names are followed through imports, own classes and their bases, and locals of a known class."""
    blank = dict.fromkeys(COLUMNS) | {"path": path, "language": "python"}
    tree = ast.parse(text)
    package = path.removesuffix(".py").removesuffix("/__init__").replace("/", ".")
    bound: dict[str, str] = {}
    for node in ast.walk(tree):
        if isinstance(node, ast.Import):
            for a in node.names:
                bound[a.asname or a.name.split(".")[0]] = a.name if a.asname else a.name.split(".")[0]
        elif isinstance(node, ast.ImportFrom):
            base = ".".join(package.split(".")[: len(package.split(".")) - node.level + (1 if path.endswith("__init__.py") else 0)]) if node.level else ""
            for a in node.names:
                bound[a.asname or a.name] = ".".join(x for x in (base, node.module or "", a.name) if x)
    functions = (ast.FunctionDef, ast.AsyncFunctionDef)
    classes = {n.name: n for n in tree.body if isinstance(n, ast.ClassDef)}
    top = {n.name for n in tree.body if isinstance(n, functions)} | set(classes)
    methods = {c: {x.name for x in n.body if isinstance(x, functions)} for c, n in classes.items()}
    rows: list[dict] = []

    def dotted(node) -> str | None:
        if isinstance(node, ast.Name):
            return node.id
        if isinstance(node, ast.Attribute) and (head := dotted(node.value)):
            return f"{head}.{node.attr}"
        return "super()" if isinstance(node, ast.Call) and isinstance(node.func, ast.Name) and node.func.id == "super" else None

    def method_of(cls: str, name: str) -> str:
        """The class that has a method: the class itself, then its bases, nearest first; else a guess by name."""
        queue, seen = [cls], set()
        while queue:
            c = queue.pop(0)
            if c in seen:
                continue
            seen.add(c)
            if name in methods.get(c, ()):
                return f"{path}::{c}.{name}"
            if c in classes:
                queue += [b for b in map(dotted, classes[c].bases) if b]
            elif c in bound:
                return f"{bound[c]}.{name}"
        return f"{cls}.{name}"

    def target(name: str, cls: str | None, local: dict[str, str]) -> str | None:
        head, _, rest = name.partition(".")
        if head in ("self", "cls") and cls:
            return method_of(cls, rest) if rest and "." not in rest else None
        if head == "super()":
            up = next((b for b in map(dotted, classes[cls].bases) if b), None) if cls in classes else None
            return method_of(up, rest) if up and rest else None
        if head in local:
            return method_of(local[head], rest) if rest and "." not in rest else f"{local[head]}.{rest}" if rest else None
        if head in top:
            return f"{path}::{head}" + (f".{rest}" if rest else "")
        if head in bound:
            if bound[head].split(".")[0] in sys.stdlib_module_names:
                return None
            return bound[head] + (f".{rest}" if rest else "")
        return None if hasattr(builtins, head) else name

    def calls(node, caller: str, cls: str | None) -> None:
        local: dict[str, str] = {}
        for a in [*node.args.posonlyargs, *node.args.args, *node.args.kwonlyargs] if isinstance(node, functions) else []:
            if a.annotation is not None and (t := dotted(a.annotation)):
                local[a.arg] = t
                if (to := target(t, None, {})) and not hasattr(builtins, t):
                    rows.append(blank | {"row_kind": "call", "id": caller, "callee": to, "relation": "type", "call_line": a.lineno})
        for x in ast.walk(node):
            value, names = (x.value, x.targets) if isinstance(x, ast.Assign) else (x.value, [x.target]) if isinstance(x, ast.AnnAssign) and x.value is not None else (None, [])
            if isinstance(value, ast.Call) and (t := dotted(value.func)) and t.split(".")[-1][:1].isupper():
                local |= {n.id: t for n in names if isinstance(n, ast.Name)}
        for x in [*node.decorator_list, *ast.walk(node)]:
            f = x.func if isinstance(x, ast.Call) else x if x in node.decorator_list else None
            if f is not None and (name := dotted(f)) and (to := target(name, cls, local)):
                rows.append(blank | {"row_kind": "call", "id": caller, "callee": to, "relation": "call", "call_line": x.lineno})

    def component(node, name: str, kind: str) -> str:
        own = f"{path}::{name}"
        args = [a.arg for a in (*node.args.posonlyargs, *node.args.args, *node.args.kwonlyargs)] if kind != "class" else None
        bases = [ast.unparse(b) for b in node.bases] if kind == "class" else None
        rows.append(blank | {"row_kind": "component", "id": own, "component_type": kind, "node_type": kind, "name": node.name, "start_line": node.lineno, "end_line": node.end_lineno, "source_code": ast.get_source_segment(text, node), "docstring": ast.get_docstring(node), "parameters": args, "base_classes": bases})
        return own

    for node in tree.body:
        if isinstance(node, functions):
            calls(node, component(node, node.name, "function"), None)
        elif isinstance(node, ast.ClassDef):
            own = component(node, node.name, "class")
            for b in node.bases:
                if (name := dotted(b)) and (to := target(name, None, {})):
                    rows.append(blank | {"row_kind": "call", "id": own, "callee": to, "relation": "inherits", "call_line": node.lineno})
            for x in node.body:
                if isinstance(x, functions):
                    calls(x, component(x, f"{node.name}.{x.name}", "method"), node.name)
    return rows


#: How a language is read; another one is added here.
READERS = {"python": python, "vue": vue} | {n: (lambda p, t, n=n: scanned(p, t, n)) for n in LEXICONS}


def read_file(path: str, text: str | None, language: str) -> list[dict]:
    try:
        rows = READERS[language](path, text or "")
    except (SyntaxError, ValueError, RecursionError, KeyError):
        rows = []
    if not any(r["row_kind"] == "component" for r in rows):
        rows.append(dict.fromkeys(COLUMNS) | {"row_kind": "component", "path": path, "language": language, "id": f"{path}::__file__", "component_type": "file", "node_type": "file", "name": path.rsplit("/", 1)[-1], "start_line": 1, "end_line": (text or "").count("\n") + 1})
    return rows


#: Rows that a worker holds before it hands them on.
PIECE = 2000


def extract(files: DataFrame) -> DataFrame:
    """Components, calls and the types of variables in `files` (path, text, language): three kinds of rows, told apart by row_kind (component, call, binding: a variable `name` of the scope `id` is a
    `callee`, or what the function `callee` gives back where that ends in brackets; `()` is what the function `id` itself gives back). Null texts are empty."""
    ship_package(files.sparkSession)

    def run(frames):
        import pandas as pd

        told = lambda rows: pd.DataFrame(rows, columns=COLUMNS).astype({c: "Int32" for c in ("start_line", "end_line", "call_line")})
        for frame in frames:
            rows = []
            for p, t, x in zip(frame["path"], frame["text"], frame["language"]):
                rows += read_file(p, t, x)
                if len(rows) >= PIECE:
                    yield told(rows)
                    rows = []
            yield told(rows)

    read = files.filter(F.col("language").isin(list(READERS))).select("path", "text", "language")
    # reading costs far more than its bytes tell: a plan that goes by bytes would leave it to a few tasks
    return read.repartition(int(files.sparkSession.conf.get("spark.sql.shuffle.partitions")), "path").mapInPandas(run, SCHEMA)


def language_of(path: Column) -> Column:
    """The language by the ending of a path; null for others."""
    return F.element_at(F.create_map(*[x for k, v in EXTENSIONS.items() for x in (F.lit(k), F.lit(v))]), F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1)))


# fixed values: what a class of a user interface is, by what it extends
WIDGETS = {"StatelessWidget": "widget", "StatefulWidget": "widget", "State": "state", "ConsumerWidget": "widget", "ConsumerStatefulWidget": "widget", "ConsumerState": "state", "HookWidget": "widget", "Notifier": "provider", "AsyncNotifier": "provider", "StateNotifier": "provider", "ChangeNotifier": "provider", "Bloc": "bloc", "Cubit": "bloc", "InheritedWidget": "widget"}


def ui_kind(bases: Column) -> Column:
    """The kind of the first base that says one."""
    kinds = F.create_map(*[x for k, v in WIDGETS.items() for x in (F.lit(k), F.lit(v))])
    return F.get(F.filter(F.transform(F.coalesce(bases, F.array().cast("array<string>")), lambda b: F.element_at(kinds, F.regexp_extract(b, r"^_?\$?(\w+)", 1))), lambda x: x.isNotNull()), F.lit(0))
