"""Scalar functions on text, as Column expressions inside code generation where Spark has them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: words that are not indexed
STOPWORDS = (
    "a an and are as at be by does do for from how i if in is it its of on or "
    "the this that to was what when where which who why will with you your can "
    "we our me my there their them they then than so not no use used using"
).split()

CHARS_PER_TOKEN = 3.6


#: Steps of the stemmer. Each replaces its one argument, so the expression grows with the steps and not with their product;
#: the mark of the first keeps the others off.
_STEPS = (
    (r"^(.{2,})ies$", "$1y\u0001"),
    (r"^(.{2,}[^sui])s$", "$1"),
    (r"^(?:(.{3,})ing|(.{2,}[^e])ed)$", "$1$2"),
    (r"^(?:([A-Za-z]+)([bcdghjkmnpqrtvwxy])\2e|([A-Za-z]{2,})([bcdghjkmnpqrtvwxy])\4|([A-Za-z]{2,}[A-Za-df-z])e)$", "$1$2$3$4$5"),
    ("\u0001$", ""),
)


def stem(term: Column) -> Column:
    """Light suffix stripping: ies to y, plural s, ing or ed, final e, doubled final consonant; identifiers and other scripts keep their end."""
    for pattern, by in _STEPS:
        term = F.regexp_replace(term, pattern, by)
    return term


def _indexed(words: Column) -> Column:
    return F.filter(words, lambda w: (F.length(w) > 1) & ~w.isin(STOPWORDS))


def words(text: Column) -> Column:
    """All Unicode words, lower-cased."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"(?U)\w+"), F.lit(0))


def whole_terms(text: Column) -> Column:
    """Stems of the whole words that are indexed, repetitions kept."""
    return F.transform(_indexed(words(text)), stem)


def terms(text: Column) -> Column:
    """Stems of whole words and, where they differ, of their camel-case and underscore parts."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"(?U)\w+"), F.lit(0))

    # fixed value: where identifiers are cut
    camel = r"[A-Z]+(?=[A-Z][a-z])|[A-Z]?[a-z]+|[A-Z]+|\d+"

    def parts(word: Column) -> Column:
        chunks = F.split(word, "_")
        pieces = lambda c: F.when(c.rlike(r"^\p{ASCII}*$"), F.regexp_extract_all(c, F.lit(camel), F.lit(0))).otherwise(F.array(c))
        return F.transform(F.flatten(F.transform(chunks, pieces)), F.lower)

    def of(word: Column) -> Column:
        own, split = F.array(F.lower(word)), parts(word)
        return F.concat(_indexed(own), F.when(split == own, F.array().cast("array<string>")).otherwise(_indexed(split)))

    return F.transform(F.flatten(F.transform(found, of)), stem)


def approx_tokens(chars: Column) -> Column:
    """Tokens of a text of so many characters, for retrieval budgets."""
    return F.greatest(F.lit(1), F.floor(chars / F.lit(CHARS_PER_TOKEN)) + 1).cast("long")


def diff_tokens(chars: Column) -> Column:
    """Tokens of a text of so many characters, for the cap on diffs."""
    return (F.floor(chars / 4) + 1).cast("long")


def slug(heading: Column) -> Column:
    """Anchor of a heading: tags out, trimmed, lower case, spaces to dashes, signs out."""
    plain = F.lower(F.trim(F.regexp_replace(heading, "<[^>]+>", "")))
    return F.replace(F.regexp_replace(plain, r"[^\p{L}\p{M}\p{N} _-]", ""), F.lit(" "), F.lit("-"))


def body_hash(source: Column) -> Column:
    """SHA-1 of the text with white space collapsed."""
    return F.sha1(F.regexp_replace(F.trim(F.regexp_replace(source, r"(?U)\s+", " ")), r"(?U)\s+", " "))


def document_source(docstring: Column, source: Column) -> Column:
    """The source, the docstring before it unless it holds it already."""
    return F.when(F.coalesce(docstring, F.lit("")).isin("") | F.contains(source, docstring), source).otherwise(F.concat_ws("\n", docstring, source))


def normal_id(component: Column) -> Column:
    """Backslashes of the path, not of the name, become slashes."""
    path = F.replace(F.substring_index(component, "::", 1), F.lit("\\"), F.lit("/"))
    return F.when(F.contains(component, F.lit("::")), F.concat(path, F.substring(component, F.instr(component, "::"), F.length(component)))).otherwise(path)


def line_of(text: Column, offset: Column) -> Column:
    """Line number, from 1, of a character offset from 0."""
    head = F.left(text, offset)
    return (F.length(head) - F.length(F.replace(head, F.lit("\n"), F.lit(""))) + 1).cast("long")


def numbered(text: Column, first: Column) -> Column:
    """Source with right-aligned line numbers."""
    lines = F.split(text, "\n")
    width = F.length((first + F.size(lines) - 1).cast("string"))
    return F.array_join(F.transform(lines, lambda line, i: F.concat(F.lpad((first + i).cast("string"), width, F.lit(" ")), F.lit("  "), line)), "\n")


def safe_file_name(name: Column) -> Column:
    """At most 180 characters of letters, digits, dots and dashes, and the start of the SHA-1."""
    return F.concat(F.left(F.regexp_replace(name, r"[^A-Za-z0-9._-]+", "_"), F.lit(180)), F.lit("-"), F.left(F.sha1(name), F.lit(8)))


def head_and_tail(text: Column, most: int, marker: str = "\n...\n") -> Column:
    """The start and the end of a text that is too long."""
    half = most // 2
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.left(text, F.lit(half)), F.lit(marker), F.right(text, F.lit(half))))


def clamp_score(text: Column, default: int = 0) -> Column:
    """An integer from 0 to 100; the default where there is none."""
    number = F.try_to_number(F.regexp_extract(text, r"^\s*(-?\d{1,9})", 1), F.lit("S999999999")).cast("int")
    return F.when(number.isNull(), F.lit(default)).otherwise(F.greatest(F.lit(0), F.least(F.lit(100), number)))


def word_boundary(text: Column, name: str) -> Column:
    """Whether the name stands in the text as a whole identifier."""
    return text.rlike(rf"(?<![\w$])\Q{name}\E(?![\w$])")


def first_sentence(text: Column, most: int = 160) -> Column:
    found = F.regexp_extract(text, r"(?s)^(.+?[.!?])(\s|$)", 1)
    return F.left(F.when(found == "", text).otherwise(found), F.lit(most))


def in_thousands(n: Column) -> Column:
    """A count as people write it: 950, 1.2k, 3.4M."""
    return F.when(n < 1000, n.cast("string")).when(n < 1_000_000, F.concat(F.format_string("%.1f", n / 1000.0), F.lit("k"))).otherwise(F.concat(F.format_string("%.1f", n / 1_000_000.0), F.lit("M")))


def duration(seconds: Column) -> Column:
    """45s, 3m 05s, 2h 07m."""
    s = F.floor(F.greatest(F.lit(0), seconds)).cast("long")
    return F.when(s < 60, F.concat(s.cast("string"), F.lit("s"))).when(s < 3600, F.format_string("%dm %02ds", F.floor(s / 60), s % 60)).otherwise(F.format_string("%dh %02dm", F.floor(s / 3600), F.floor(s % 3600 / 60)))


def human_size(n: Column) -> Column:
    """Bytes as B, KB, MB or GB."""
    return F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B"))).when(n < 1 << 20, F.format_string("%.1f KB", n / 1024.0)).when(n < 1 << 30, F.format_string("%.1f MB", n / float(1 << 20))).otherwise(F.format_string("%.1f GB", n / float(1 << 30)))


def dollars(x: Column) -> Column:
    """$0.0042 below a cent's tenth part, $1.25 else; unknown for null."""
    return F.when(x.isNull(), "unknown").when(x < 0.1, F.format_string("$%.4f", x.cast("double"))).otherwise(F.format_string("$%.2f", x.cast("double")))


def file_parts(path: Column) -> Column:
    """dir, name, stem and ending of a path."""
    name = F.element_at(F.split(path, "/"), -1)
    return F.struct(F.regexp_extract(path, "^(.*)/[^/]*$", 1).alias("dir"), name.alias("name"), F.regexp_replace(name, r"(?<=.)\.[^.]*$", "").alias("stem"), F.lower(F.regexp_extract(name, r"(?<=.)(\.[^.]+)$", 1)).alias("ending"))


def epoch(stamp: Column) -> Column:
    """Seconds since 1970 of an ISO time, with or without zone; null for anything else."""
    return F.try_to_timestamp(F.regexp_replace(stamp, "Z$", "+00:00")).cast("double")


def age_days(stamp: Column, now: Column) -> Column:
    return F.floor((now.cast("timestamp").cast("double") - epoch(stamp)) / 86_400).cast("int")


def day_name(prefix: str, ts: Column) -> Column:
    """prefix-2024-01-31."""
    return F.concat(F.lit(prefix + "-"), F.date_format(ts, "yyyy-MM-dd"))


def clean_list(items: Column, most: int) -> Column:
    """The first `most` strings that are not blank, trimmed; null is empty."""
    return F.slice(F.filter(F.transform(F.coalesce(items, F.array().cast("array<string>")), lambda x: F.trim(x)), lambda x: x.isNotNull() & (x != "")), 1, most)


def origin(url: Column) -> Column:
    """Scheme and host of an address, in lower case, without user and the usual port."""
    host = F.regexp_extract(url, r"^(?i)(https?://)(?:[^/@]*@)?([^/?#]+)", 2)
    scheme = F.lower(F.regexp_extract(url, r"^(?i)(https?://)", 1))
    return F.when(scheme == "", None).otherwise(F.concat(scheme, F.regexp_replace(F.lower(host), r":(80|443)$", "")))


def repository(url: Column) -> Column:
    """host/owner/name of a repository's address in any form."""
    plain = F.regexp_replace(F.regexp_replace(F.trim(url), r"^git@([^:]+):", "$1/"), r"^(?i)(?:https?|ssh|git)://(?:[^/@]*@)?", "")
    return F.lower(F.regexp_replace(plain, r"(\.git)?/*$", ""))


def clone_address(url: Column) -> Column:
    """The address to clone a repository of the public forge from: scheme, forge, owner and name alone, whatever page of it or short form (owner/name) was given; anything else as it stands."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(url), r"^https?://", ""), r"^www\.", "")
    parts = F.split(bare, "/")
    on_forge = bare.startswith("github.com/")
    first = F.when(on_forge, 1).otherwise(0)
    known = F.when(on_forge, F.size(parts) >= 3).otherwise(F.size(parts) >= 2)
    scheme = F.when(F.trim(url).startswith("http://"), "http://").otherwise("https://")
    return F.when(known, F.concat(scheme, F.lit("github.com/"), F.get(parts, first), F.lit("/"), F.regexp_replace(F.get(parts, first + 1), r"\.git$", ""))).otherwise(url)


def repository_parts(url: Column) -> Column:
    """owner, name and full_name of a repository's address, by its last two parts; unknown where it has fewer."""
    parts = F.split(F.regexp_replace(url, r"/+$", ""), "/")
    known = F.size(parts) > 1
    owner = F.when(known, F.get(parts, F.size(parts) - 2)).otherwise("unknown")
    name = F.when(known, F.replace(F.get(parts, F.size(parts) - 1), F.lit(".git"), F.lit(""))).otherwise("unknown")
    return F.struct(owner.alias("owner"), name.alias("name"), F.when(known, F.concat(owner, F.lit("/"), name)).otherwise("unknown").alias("full_name"))


# fixed values: names of languages people write
LANGUAGE_TAGS = {"english": "en", "chinese": "zh", "japanese": "ja", "korean": "ko", "german": "de", "french": "fr", "spanish": "es", "portuguese": "pt", "russian": "ru", "vietnamese": "vi", "italian": "it"}


def language_tag(name: Column) -> Column:
    """The tag of a language by name or tag, region in capitals; English for none."""
    low = F.lower(F.trim(F.replace(name, F.lit("_"), F.lit("-"))))
    by_name = F.element_at(F.create_map(*[x for k, v in LANGUAGE_TAGS.items() for x in (F.lit(k), F.lit(v))]), low)
    tagged = F.when(low.rlike("^[a-z]{2,3}-[a-z]{2}$"), F.concat(F.substring_index(low, "-", 1), F.lit("-"), F.upper(F.substring_index(low, "-", -1)))).otherwise(low)
    return F.coalesce(by_name, F.when(F.coalesce(low, F.lit("")) == "", "en").otherwise(tagged))


def clipped(text: Column, tokens: int) -> Column:
    """The start of a text that is about so many tokens, up to the last blank."""
    most = int(tokens * CHARS_PER_TOKEN)
    return F.when(F.length(text) <= most, text).otherwise(F.regexp_replace(F.left(text, F.lit(most)), r"\s+\S*\z", ""))


def message_tokens(texts: Column) -> Column:
    """Tokens of a conversation's messages: each has eight besides its text."""
    return F.aggregate(F.transform(F.coalesce(texts, F.array().cast("array<string>")), lambda t: approx_tokens(F.length(F.coalesce(t, F.lit("")))) + 8), F.lit(0).cast("long"), lambda a, x: a + x)


def counters_merged(a: Column, b: Column) -> Column:
    """Two maps of counts as one."""
    return F.map_zip_with(a, b, lambda _, x, y: F.coalesce(x, F.lit(0)) + F.coalesce(y, F.lit(0)))
