"""Markdown pages: plain text, references, diagrams, outlines, links between pages."""

from __future__ import annotations

import ast
import json
import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions import text as T
from corvane.operators.extract import sections_of
from corvane.operators.hierarchy import _outside_fences, relative_link
from corvane.session import ship_package

RELATED = ("<!-- related -->", "<!-- /related -->")
SUMMARY = r"<!--\s*summary:\s*(.*?)\s*-->"


def plain(line: Column) -> Column:
    """A line of Markdown as text: images and links by their words, code without its ticks, no emphasis, tags, list marks or table bars."""
    steps = ((r"!\[([^\]]*)\]\([^)]*\)", "$1"), (r"\[([^\]]*)\]\([^)]*\)", "$1"), (r"<[^>]+>", ""), (r"^\s*(?:[-*+]|\d+[.)])\s+", ""), (r"^\s*>+\s?", ""), (r"`+", ""), (r"(\*\*|__|~~)", ""), (r"(?<![\w*])\*|\*(?![\w*])", ""), (r"\|", " "), (r"\s+", " "))
    return F.trim(reduce(lambda c, s: F.regexp_replace(c, *s), steps, line))


def heading(text: Column) -> Column:
    """A heading without links, code ticks and emphasis."""
    return F.trim(reduce(lambda c, s: F.regexp_replace(c, *s), ((r"\[([^\]]*)\]\([^)]*\)", "$1"), ("`", ""), (r"(\*\*|__)", ""), (r"\s+#+\s*$", "")), text))


def references(pages: DataFrame, ids: DataFrame, names: DataFrame) -> DataFrame:
    """page, kind (links, ids, names) and ref of `pages` (page, text): pages linked or named, known ids, known names in ticks."""
    text = F.coalesce("text", F.lit(""))
    found = pages.select("page", text.alias("text"))
    linked = F.regexp_extract_all("text", F.lit(r"\]\(([^)#\s]+?\.md)(?:#[^)]*)?\)"), F.lit(1))
    bare = F.regexp_extract_all("text", F.lit(r"(?<![\w/(.-])((?:[\w.-]+/)*[\w.-]+\.md)\b(?!\))"), F.lit(1))
    links = found.select("page", F.explode(F.array_distinct(F.concat(linked, bare))).alias("ref")).filter("NOT startswith(ref, 'http')").select("page", F.lit("links").alias("kind"), F.regexp_replace(F.regexp_replace("ref", r"^(\.{1,2}/)+", ""), r"\.md$", "").alias("ref"))
    named = found.select("page", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"([\w./\\-]+::[\w.$]+)"), F.lit(1)))).alias("ref")).select("page", T.normal_id(F.col("ref")).alias("ref")).join(ids.select(F.col("id").alias("ref")).distinct(), "ref", "left_semi")
    ticked = found.select("page", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"`([\w.$]+)(?:\(\))?`"), F.lit(1)))).alias("ref")).join(names.select(F.col("name").alias("ref")).distinct(), "ref", "left_semi")
    return links.unionByName(named.select("page", F.lit("ids").alias("kind"), "ref")).unionByName(ticked.select("page", F.lit("names").alias("kind"), "ref")).distinct()


def page_components(listed: DataFrame, refs: DataFrame, components: DataFrame) -> DataFrame:
    """page and component_id: what a page's module lists and what the page names, as far as it exists."""
    both = listed.select(F.array_join("path", "/").alias("page"), "component_id").union(refs.filter("kind = 'ids'").select("page", F.col("ref").alias("component_id")))
    return both.distinct().join(components.select(F.col("id").alias("component_id")), "component_id", "left_semi").select("page", "component_id")


def fences(text: str) -> list[tuple[str, int, int, str]]:
    """(language, start, end, body) of the fenced blocks of a text; an open one ends with it."""
    out, at, open_ = [], 0, None
    for line in (text or "").splitlines(keepends=True):
        m = re.match(r" {0,3}(`{3,}|~{3,})\s*([\w-]*)[^\n]*\n?$", line)
        if m and open_ is None:
            open_ = (m[1], m[2].lower(), at, at + len(line))
        elif m and m[1][0] == open_[0][0] and len(m[1]) >= len(open_[0]) and not m[2]:
            out.append((open_[1], open_[2], at + len(line), text[open_[3] : at]))
            open_ = None
        at += len(line)
    return out + ([(open_[1], open_[2], at, text[open_[3] : at])] if open_ else [])


def quoted_labels(diagram: str) -> str:
    """Labels of a flow chart that hold signs its grammar takes for its own, in quotes; lines where the label's end is not clear stay."""

    def fix(m):
        opens, label, closes = m[2], m[3], m[4]
        if label.startswith('"') or not re.search(r"[(){}<>|#;:&@,/\\]", label) or '"' in label:
            return m[0]
        return f'{m[1]}{opens}"{label}"{closes}'

    out = []
    for line in diagram.split("\n"):
        if re.match(r"\s*(?:flowchart|graph|subgraph|classDef|class|style|linkStyle|click|%%|end\b)", line) or line.count("[") != line.count("]"):
            out.append(line)
            continue
        out.append(re.sub(r"(\b\w+)(\[)(?![\[(/\\])([^\[\]\n]+)(\])(?!\])", fix, line))
    return "\n".join(out)


def outline_of(text: str) -> str:
    """A page in short: each heading and the first paragraph under it."""
    out = []
    for anchor, level, title, content in sections_of(text):
        first = content.split(". ")[0].strip()
        out.append("#" * level + " " + title + (f"\n{first[:200]}" if first else ""))
    return "\n".join(out)


def first_title(text: str) -> str | None:
    """The first heading of level one outside fences."""
    return next((t for _, level, t, _ in sections_of(text) if level == 1), None)


def overview_fault(text: str) -> str | None:
    """Why a text is no overview: no heading, no prose, or a plan of one."""
    bare = re.sub(r"^\s*(#.*|[-*|>].*|\d+[.)].*)$", "", re.sub(r"(```|~~~).*?\1", "", text or "", flags=re.S), flags=re.M)
    if not re.search(r"^#{1,2} \S", text or "", re.M):
        return "no heading"
    if len(re.findall(r"\w+", bare)) < 20:
        return "no prose"
    return "a plan" if re.search(r"(?i)^\s*(I will|I'll|let me|next,? I|here is (the|a) plan|plan:)", bare, re.M) else None


def described(pages: DataFrame) -> DataFrame:
    """page, title, summary, outline, fault, diagrams (number) and n_sections of `pages` (page, text)."""
    ship_package(pages.sparkSession)

    def run(frames):
        import pandas as pd

        for frame in frames:
            rows = [(p, first_title(t), (m[1] if (m := re.search(SUMMARY, t or "", re.S)) else None), outline_of(t), overview_fault(t), sum(f[0] == "mermaid" for f in fences(t)), len(sections_of(t))) for p, t in zip(frame["page"], frame["text"])]
            yield pd.DataFrame(rows, columns=["page", "title", "summary", "outline", "fault", "diagrams", "n_sections"])

    return pages.select("page", "text").mapInPandas(run, "page string, title string, summary string, outline string, fault string, diagrams int, n_sections int")


def best_headings(sections: DataFrame, names: DataFrame) -> DataFrame:
    """page, name and anchor: the shortest heading below the first level that mentions a name; sections (page, anchor, level, title, ord). Both sides meet by the words of the heading."""
    words = sections.filter("level > 1").select("page", "anchor", "title", "ord", F.explode(F.array_distinct(F.regexp_extract_all("title", F.lit(r"[\w$]+"), F.lit(0)))).alias("name"))
    return words.join(names.select("name").distinct(), "name").groupBy("page", "name").agg(F.min_by("anchor", F.struct(F.length("title"), "ord")).alias("anchor"))


# ---- links


def page_keys(page: str) -> list[str]:
    """What a link to a page may be written like: itself, its name, and that without case, blanks and dashes."""
    stem = page.removesuffix(".md")
    name = stem.rsplit("/", 1)[-1]
    loose = lambda x: re.sub(r"[\s_-]+", "", x).lower()
    return list(dict.fromkeys([stem, name, stem.lower(), name.lower(), loose(name)]))


def stem_index(pages: list[str]) -> dict[str, str]:
    """The page for each key that one page alone has; exact keys come first."""
    out: dict[str, str] = {}
    for rank in range(5):
        level: dict[str, set] = {}
        for p in pages:
            keys = page_keys(p)
            if rank < len(keys):
                level.setdefault(keys[rank], set()).add(p)
        for k, ps in level.items():
            if len(ps) == 1:
                out.setdefault(k, next(iter(ps)))
    return out


def repaired_links(page: str, text: str, index: dict[str, str], anchors: dict[str, set]) -> str:
    """Links of a page set right: images and addresses stay; an anchor must exist, as it stands or as a slug; a page is found by its name in any spelling; what leads nowhere becomes its words."""

    def slug(x):
        return re.sub(r"[^\w -]", "", x.lower()).strip().replace(" ", "-")

    def link(m):
        words, target = m[2], m[3]
        if m[1] or re.match(r"[a-z][a-z0-9+.-]*:|/", target):
            return m[0]
        to, _, anchor = target.partition("#")
        if not to:
            here = anchors.get(page, set())
            return m[0] if anchor in here else f"[{words}](#{slug(anchor)})" if slug(anchor) in here else words
        if not to.endswith(".md"):
            return m[0]
        there = next((index[k] for k in [re.sub(r"^(\.{1,2}/)+", "", to).removesuffix(".md"), *page_keys(to)] if k in index), None)
        if there is None:
            return words
        good = anchors.get(there, set())
        anchor = anchor if anchor in good else slug(anchor) if slug(anchor) in good else ""
        return f"[{words}]({relative_link(page, there)}{'#' + anchor if anchor else ''})"

    return _outside_fences(text, lambda line: "".join(p if i % 2 else re.sub(r"(!?)\[([^\]]*)\]\(([^)\s]+)\)", link, p) for i, p in enumerate(re.split(r"(`[^`]*`)", line))))


def linked_terms(page: str, text: str, terms: dict[str, str]) -> tuple[str, list[str]]:
    """The first mention of each term (term: page and anchor) in each section of the first two levels made a link, longest term first; not in headings, code, links or tags, not to the page itself. Also the pages linked."""
    todo = sorted((t for t, to in terms.items() if to.split("#")[0] != page), key=lambda t: (-len(t), t))
    if not todo:
        return text, []
    pattern = re.compile(r"(`[^`]*`|!?\[[^\]]*\]\([^)]*\)|<[^>]+>)|(?<![\w$])(" + "|".join(map(re.escape, todo)) + r")(?![\w$])")
    done: set[str] = set()
    out: list[str] = []

    def put(m):
        if m[1] and (old := re.match(r"\[`?([^\]`]*)`?\]", m[1])):
            done.add(old[1])  # linked before
        word = m[2] or (m[1][1:-1] if m[1].startswith("`") and m[1][1:-1] in terms and m[1][1:-1] in todo else None)
        if word is None or word in done:
            return m[0]
        done.add(word)
        to, _, anchor = terms[word].partition("#")
        out.append(to)
        return f"[{m[0]}]({relative_link(page, to)}{'#' + anchor if anchor else ''})"

    def line(x):
        if m := re.match(r" {0,3}(#{1,6}) ", x):
            if len(m[1]) <= 2:
                done.clear()
            return x
        return pattern.sub(put, x)

    return _outside_fences(text, line), list(dict.fromkeys(out))


def without_related(text: str) -> str:
    return re.sub(r"\n*" + re.escape(RELATED[0]) + r".*?" + re.escape(RELATED[1]) + r"\n*", "\n", text, flags=re.S)


def with_related(page: str, text: str, relations: list[tuple[str, str]]) -> str:
    """The page with a block of its relations (name of the relation, page) that it does not link yet; an old block goes. A second time changes nothing."""
    body = without_related(text).rstrip("\n")
    there = {m for m in re.findall(r"\]\(([^)#\s]+)", body)}
    groups: dict[str, list[str]] = {}
    for how, to in relations:
        link = relative_link(page, to)
        if to != page and link not in there:
            groups.setdefault(how, []).append(f"[{to.removesuffix('.md').rsplit('/', 1)[-1]}]({link})")
    if not groups:
        return body + "\n"
    return body + "\n\n" + RELATED[0] + "\n" + "\n".join(f"- {k}: {', '.join(dict.fromkeys(v))}" for k, v in groups.items()) + "\n" + RELATED[1] + "\n"


def crosslinked(pages: DataFrame, terms: DataFrame, relations: DataFrame) -> DataFrame:
    """`pages` (page, text) with links repaired, terms (term, page, anchor; those of one page only) linked, relations (page, how, other, ord) appended. Names, anchors and terms of one documentation are broadcast; its texts stay where they are."""
    ship_package(pages.sparkSession)
    spark = pages.sparkSession

    def anchors(frames):
        import pandas as pd

        for frame in frames:
            yield pd.DataFrame([(p, a) for p, t in zip(frame["page"], frame["text"]) for a, *_ in sections_of(t or "")], columns=["page", "anchor"])

    known: dict[str, set] = {r["page"]: set() for r in pages.select("page").collect()}
    for r in pages.select("page", "text").mapInPandas(anchors, "page string, anchor string").collect():
        known[r["page"]].add(r["anchor"])
    one = terms.groupBy("term").agg(F.countDistinct("page").alias("n"), F.min("page").alias("page"), F.min_by("anchor", "page").alias("anchor")).filter("n = 1 AND length(term) >= 4")
    by_term = {r["term"]: r["page"] + (f"#{r['anchor']}" if r["anchor"] else "") for r in one.collect()}
    shared = spark.sparkContext.broadcast((stem_index(sorted(known)), known, by_term))
    grouped = relations.groupBy("page").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "how", "other"))), lambda x: F.struct(x["how"], x["other"])).alias("rel"))
    rows = pages.select("page", "text").join(grouped, "page", "left")

    def run(frames):
        index, known, by_term = shared.value
        for frame in frames:
            out = []
            for p, t, rel in zip(frame["page"], frame["text"], frame["rel"]):
                body = repaired_links(p, without_related(t or ""), index, known)
                body, _ = linked_terms(p, body, by_term)
                out.append(with_related(p, body, [tuple(x.values()) if isinstance(x, dict) else tuple(x) for x in (rel if rel is not None else [])]))
            yield frame.assign(text=out)[["page", "text"]]

    return rows.mapInPandas(run, "page string, text string")


def related_modules(edges: DataFrame, most: int = 5) -> DataFrame:
    """`edges` between modules (src, dst, n) as the first `most` of each by number, then name; relatives in the tree left out."""
    apart = edges.filter(~((F.slice("src", F.lit(1), F.least(F.size("src"), F.size("dst")))) == F.slice("dst", F.lit(1), F.least(F.size("src"), F.size("dst")))))
    nth = Window.partitionBy("src").orderBy(F.desc("n"), "dst")
    return apart.withColumn("_n", F.row_number().over(nth)).filter(F.col("_n") <= most).drop("_n")


# ---- answers of models


def json_in(text: str | None):
    """The JSON value in prose: of a fence, or of the first brace that closes; commas before a brace are forgiven. None where there is none."""
    for part in [*re.findall(r"```(?:json)?\s*(.*?)```", text or "", re.S), text or ""]:
        for m in re.finditer(r"[{\[]", part):
            depth, quote, esc = 0, False, False
            for i in range(m.start(), len(part)):
                c = part[i]
                if quote:
                    quote, esc = esc or c != '"', not esc and c == "\\"
                    continue
                quote = c == '"'
                depth += (c in "{[") - (c in "}]")
                if not depth:
                    try:
                        return json.loads(re.sub(r",\s*([}\]])", r"\1", part[m.start() : i + 1]))
                    except ValueError:
                        break
    return None


def dict_in(text: str | None) -> dict | None:
    """A mapping out of untrusted text: JSON, or a literal of Python; nothing is run."""
    found = json_in(text)
    if isinstance(found, dict):
        return found
    for m in re.finditer(r"\{", text or ""):
        for end in range(len(text), m.start(), -1):
            if text[end - 1] == "}":
                try:
                    value = ast.literal_eval(text[m.start() : end])
                except (ValueError, SyntaxError, MemoryError, RecursionError):
                    continue
                return value if isinstance(value, dict) else None
        break
    return None
