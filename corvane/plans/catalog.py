"""Relational operators as SQL plans over the relations of `sources.tables`; the same text, in DuckDB's dialect, is the oracle."""

from __future__ import annotations

from corvane.plans.dialect import Sql

I = "CAST({} AS BIGINT)".format  # noqa: E741

CATALOG: dict[str, Sql] = {}


def plan(f: Sql) -> Sql:
    CATALOG[f.__name__] = f
    return f


# ---- scalar functions and term statistics


@plan
def tokenize_terms(d):
    """occurrences of each term of two letters or more."""
    return f"SELECT term, count(*) AS n FROM (SELECT {d.each(d.words('text'))} AS term FROM units) t WHERE length(term) > 1 GROUP BY term"


@plan
def stem_families(d):
    """how many distinct words meet in each stem by the first two rules."""
    stem = "CASE WHEN length(w) > 4 AND w LIKE '%ies' THEN concat(substring(w, 1, length(w) - 3), 'y') WHEN length(w) > 3 AND w LIKE '%s' AND NOT (w LIKE '%ss' OR w LIKE '%us' OR w LIKE '%is') THEN substring(w, 1, length(w) - 1) ELSE w END"
    return f"SELECT stem, count(*) AS n_words FROM (SELECT DISTINCT w, {stem} AS stem FROM (SELECT {d.each(d.words('text'))} AS w FROM units) a) b GROUP BY stem"


@plan
def slug_titles(d):
    """Anchors of page titles; the nth repeat gets -n."""
    slug = f"replace({d.replaced(f'lower(trim({d.first('html', '<title>([^<]*)</title>')}))', '[^\\p{L}\\p{M}\\p{N} _-]', '')}, ' ', '-')"
    return f"SELECT page_id, CASE WHEN k = 0 THEN base ELSE concat(base, '-', CAST(k AS STRING)) END AS slug FROM (SELECT page_id, base, row_number() OVER (PARTITION BY base ORDER BY page_id) - 1 AS k FROM (SELECT page_id, {slug} AS base FROM pages) a) b"


@plan
def body_hash_dupes(d):
    """Texts equal but for white space; the first of each stays."""
    return f"SELECT body, min(id) AS first_id, count(*) AS n FROM (SELECT id, sha1({d.replaced('trim(text)', '[ \\t\\n\\r]+', ' ')}) AS body FROM units) t GROUP BY body"


@plan
def approx_token_budget(d):
    """Tokens of each source, and of the units that fit a budget of 2000."""
    return f"SELECT source, {I('sum(tokens)')} AS tokens, {I('sum(CASE WHEN tokens <= 2000 THEN tokens ELSE 0 END)')} AS small_tokens, count(*) AS n FROM units GROUP BY source"


@plan
def term_stats(d):
    """Units that hold a term, and its occurrences."""
    return f"SELECT term, count(DISTINCT id) AS df, count(*) AS cf FROM (SELECT id, {d.each(d.words('text'))} AS term FROM units) t GROUP BY term"


@plan
def field_avg_lengths(d):
    """Mean terms of a field, 1 at least."""
    parts = " UNION ALL ".join(f"SELECT '{f}' AS field, id, {d.each(d.words(x))} AS term FROM units" for f, x in (("title", "substring(text, 1, 40)"), ("path", "concat(source, ' ', lang)"), ("content", "text")))
    return f"SELECT field, floor(greatest(CAST(1 AS DOUBLE), count(*) / CAST((SELECT count(*) FROM units) AS DOUBLE)) * 1000000 + 0.5) / 1000000 AS avg_len FROM ({parts}) t GROUP BY field"


@plan
def prefix_expand(d):
    """Of the six terms from a stem on, those it begins: a short ordered look at the vocabulary for each stem."""
    starts = "starts_with" if d.duck else "startswith"
    look = " UNION ALL ".join(f"SELECT * FROM (SELECT '{q}' AS q, term FROM v WHERE term >= '{q}' ORDER BY term LIMIT 6) x{i}" for i, q in enumerate(("err", "tho", "zzz")))
    return f"WITH v AS (SELECT DISTINCT {d.each(d.words('text'))} AS term FROM units) SELECT q, term FROM ({look}) y WHERE {starts}(term, q)"


@plan
def name_pin(d):
    """Exact names first: large kinds before others, longer paths first, then by id; five pins at most, whose scores lie above all others."""
    return "SELECT id, kind, path FROM comp JOIN (SELECT min(name) AS target FROM comp) t ON name = target ORDER BY CASE WHEN kind LIKE 'STANDARD%' THEN 0 ELSE 1 END, CASE WHEN dir LIKE '%1' THEN 1 ELSE 0 END, length(path) DESC, id LIMIT 5"


@plan
def priority_rerank(d):
    """Relevance, grep hits and density in one number; the best score is one broadcast number. Scores here are made of text length."""
    return "WITH u AS (SELECT id, CAST(n_chars % 97 + 1 AS DOUBLE) AS score, CASE WHEN text LIKE '%the%' THEN 1 ELSE 0 END AS hits, tokens FROM units) SELECT id, CAST(floor((score / top + CASE WHEN hits > 0 THEN CAST(0.6 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END + CAST(0.3 AS DOUBLE) / (1 + tokens / CAST(800 AS DOUBLE))) * 1000000 + 0.5) AS BIGINT) AS priority FROM u CROSS JOIN (SELECT max(score) AS top FROM u) m"


# ---- lines, intervals


@plan
def grep_components(d):
    """Lines that match, mapped to blocks of ten lines; hits of each."""
    return f"SELECT id, {d.div('ord - 1', '10')} AS block, count(*) AS hits FROM {d.rows_of(d.lines('text'), 'id', 'units')} l WHERE {d.like('item', '(^|[^\\w])(the|der|les|que)([^\\w]|$)')} GROUP BY id, {d.div('ord - 1', '10')}"


@plan
def enclosing_interval(d):
    """The innermost of the blocks of 10 and of 50 lines that holds a line."""
    return f"""SELECT id, ord, lo, hi FROM (SELECT l.id, l.ord, b.lo, b.hi, row_number() OVER (PARTITION BY l.id, l.ord ORDER BY b.hi - b.lo, b.lo) AS k
      FROM {d.rows_of(d.lines('text'), 'id', 'units')} l JOIN (SELECT DISTINCT id, w, {d.div('ord - 1', 'w')} * w + 1 AS lo, {d.div('ord - 1', 'w')} * w + w AS hi FROM {d.rows_of(d.lines('text'), 'id', 'units')} x CROSS JOIN (SELECT 10 AS w UNION ALL SELECT 50) ww WHERE {d.div('ord - 1', 'w')} % 2 = 0) b
      ON l.id = b.id AND l.ord BETWEEN b.lo AND b.hi) t WHERE k = 1"""


@plan
def contained_units(d):
    """Units strictly inside a larger selected unit of the same file."""
    return "SELECT count(*) AS n, min(a_id) AS least FROM (SELECT DISTINCT a.l_partkey AS a_id FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber > b.l_linenumber AND a.l_linenumber + a.l_quantity < b.l_linenumber + b.l_quantity) t"


@plan
def section_extent(d):
    """From a heading to the next; a line of fewer than 25 characters stands for a heading."""
    return f"SELECT id, ord AS start_line, lead(ord) OVER (PARTITION BY id ORDER BY ord) - ord AS n_lines FROM {d.rows_of(d.lines('text'), 'id', 'units')} l WHERE length(item) < 25"


@plan
def sections_split(d):
    """Running number of the section that each line is in."""
    return f"SELECT id, section, count(*) AS n_lines, {I('sum(length(item))')} AS chars FROM (SELECT id, item, sum(CASE WHEN length(item) < 25 THEN 1 ELSE 0 END) OVER (PARTITION BY id ORDER BY ord ROWS UNBOUNDED PRECEDING) AS section FROM {d.rows_of(d.lines('text'), 'id', 'units')} l) s GROUP BY id, section".replace("SELECT id, section,", f"SELECT id, {I('section')} AS section,", 1)


# ---- graph


@plan
def edges_build(d):
    """Edges between known components."""
    return "SELECT src, dst FROM edge WHERE src IN (SELECT pk FROM comp) AND dst IN (SELECT pk FROM comp)"


@plan
def edges_reverse(d):
    """Callers of each component."""
    return f"SELECT dst AS id, {d.joined('CAST(src AS STRING)')} AS callers, count(*) AS n FROM edge GROUP BY dst"


@plan
def edges_known_only(d):
    """Edges that leave the components of small size."""
    return "SELECT src, dst FROM edge LEFT JOIN comp ON dst = pk AND tokens <= 25 WHERE pk IS NULL"


@plan
def khop_dependents_1(d):
    """What uses each component."""
    return "SELECT DISTINCT dst AS changed, src AS dependent FROM edge"


@plan
def khop_dependents_2(d):
    """What uses each component within two steps, itself excluded."""
    return "SELECT DISTINCT changed, dependent FROM (SELECT dst AS changed, src AS dependent FROM edge UNION ALL SELECT a.dst, b.src FROM edge a JOIN edge b ON b.dst = a.src) t WHERE changed <> dependent"


@plan
def callers_two_hops(d):
    """Callers with their least distance."""
    return "SELECT target, id, min(hop) AS hop FROM (SELECT dst AS target, src AS id, 1 AS hop FROM edge UNION ALL SELECT a.dst, b.src, 2 FROM edge a JOIN edge b ON b.dst = a.src) t WHERE target <> id GROUP BY target, id"


@plan
def degree_topn(d):
    """Most distinct neighbours, either way."""
    return "SELECT id, n FROM (SELECT id, count(DISTINCT other) AS n, row_number() OVER (ORDER BY count(DISTINCT other) DESC, id) AS k FROM (SELECT src AS id, dst AS other FROM edge UNION ALL SELECT dst, src FROM edge) t GROUP BY id) r WHERE k <= 20"


@plan
def lifted_edges(d):
    """Module edges through owners, without loops."""
    return "SELECT a.dir AS src, b.dir AS dst, count(*) AS n FROM edge JOIN comp a ON src = a.pk JOIN comp b ON dst = b.pk WHERE a.dir <> b.dir GROUP BY a.dir, b.dir"


@plan
def module_neighbours_top5(d):
    """Five neighbours with most edges, then by name."""
    return "SELECT src, dst, n FROM (SELECT src, dst, n, row_number() OVER (PARTITION BY src ORDER BY n DESC, dst) AS k FROM (SELECT a.path AS src, b.path AS dst, count(*) AS n FROM edge JOIN comp a ON src = a.pk JOIN comp b ON dst = b.pk WHERE a.path <> b.path GROUP BY a.path, b.path) e) r WHERE k <= 5"


@plan
def implements_by_containment(d):
    """Orders whose parts hold all parts of a smaller order."""
    return "WITH s AS (SELECT DISTINCT l_orderkey AS o, l_partkey AS m FROM lineitem), z AS (SELECT o, count(*) AS n FROM s GROUP BY o) SELECT x.o AS typ, y.o AS iface FROM s x JOIN s y ON x.m = y.m AND x.o <> y.o JOIN z ON z.o = y.o WHERE z.n >= 2 GROUP BY x.o, y.o, z.n HAVING count(*) = z.n"


@plan
def leaf_selection(d):
    """All valid nodes; from 400 on only those no other depends on."""
    return "SELECT id FROM comp LEFT JOIN (SELECT DISTINCT dst FROM edge) e ON pk = dst CROSS JOIN (SELECT count(*) AS n FROM comp) c WHERE n < 400 OR dst IS NULL"


@plan
def leaf_type_gate(d):
    """Whether functions count as leaves, from two counts."""
    return "SELECT n_oop, n_func, n_oop = 0 OR (n_oop < 20 AND n_func > n_oop) OR (n_func > 0 AND n_oop / CAST(n_oop + n_func AS DOUBLE) < CAST(0.2 AS DOUBLE)) AS with_functions FROM (SELECT count(CASE WHEN kind LIKE 'STANDARD%' THEN 1 END) AS n_oop, count(CASE WHEN kind LIKE 'ECONOMY%' THEN 1 END) AS n_func FROM comp) c"


# ---- resolution


@plan
def unique_names(d):
    """Names that one component alone has, of five letters or more."""
    return "SELECT name, min(id) AS id FROM (SELECT concat(name, ' ', kind) AS name, id FROM comp) c WHERE length(name) >= 5 GROUP BY name HAVING count(*) = 1"


@plan
def resolve_calls_ranked(d):
    """A call binds by the first rule whose key is unique: id, directory and name, path and name, name."""
    call = "SELECT pk AS caller, dir, path, CASE pk % 4 WHEN 0 THEN id WHEN 1 THEN concat(dir, '.', name) WHEN 2 THEN concat(path, '.', name) ELSE name END AS callee FROM comp"
    rules = " UNION ALL ".join(f"SELECT {r} AS r, {k} AS key, min(id) AS id FROM comp GROUP BY {k} HAVING count(*) = 1" for r, k in ((1, "id"), (2, "concat(path, '.', name)"), (3, "concat(dir, '.', name)"), (4, "name")))
    return f"SELECT caller, callee, id AS resolved, r AS rule FROM (SELECT caller, callee, i.id, i.r, row_number() OVER (PARTITION BY caller ORDER BY i.r) AS k FROM ({call}) c LEFT JOIN ({rules}) i ON callee = i.key) t WHERE k = 1"


@plan
def resolve_name_first(d):
    """A call that no unique key resolves binds to the first component of that name; resolved ones are left alone."""
    return "SELECT c.pk AS caller, f.first_id AS resolved FROM comp c JOIN (SELECT name, min(pk) AS first_id, count(*) AS n FROM comp GROUP BY name) f ON c.name = f.name WHERE n > 1"


@plan
def owner_resolve_prefix(d):
    """An unlisted id tries its enclosing names, the nearest first: the parts of its path, cut one by one."""
    cut = "regexp_extract(c.id, '^(.*)::', 1)" if d.duck else "regexp_extract(c.id, '^(.*)::', 1)"
    levels = f"SELECT c.id, 1 AS k, {cut} AS key FROM comp c UNION ALL SELECT c.id, 2, c.dir FROM comp c"
    owners = "SELECT path AS key, path AS owner FROM comp GROUP BY path HAVING count(*) >= 10 UNION ALL SELECT dir, dir FROM comp GROUP BY dir HAVING count(*) >= 20"
    return f"SELECT id, owner FROM (SELECT l.id, o.owner, row_number() OVER (PARTITION BY l.id ORDER BY CASE WHEN o.owner IS NULL THEN 1 ELSE 0 END, l.k) AS r FROM ({levels}) l LEFT JOIN ({owners}) o ON l.key = o.key) t WHERE r = 1"


@plan
def representatives(d):
    """One component for each file without a chosen one."""
    return "SELECT path, min(id) AS id FROM comp c WHERE NOT EXISTS (SELECT 1 FROM comp b WHERE b.path = c.path AND b.tokens >= 50) GROUP BY path"


@plan
def vote_partition(d):
    """A10: a supplier goes to the part brand with most votes, then by name."""
    return "SELECT sk, dir, n FROM (SELECT sk, dir, n, row_number() OVER (PARTITION BY sk ORDER BY n DESC, dir) AS k FROM (SELECT l_suppkey AS sk, dir, count(DISTINCT l_partkey) AS n FROM lineitem JOIN comp ON l_partkey = pk GROUP BY l_suppkey, dir) v) r WHERE k = 1"


@plan
def nearest_module(d):
    """A file goes to the module that overflows least, is nearest, lightest, first by name. Of the modules that are no nearer than others only the lightest can win: each file meets its own and that one."""
    load = "SELECT dir, sum(tokens) AS load, min(path) AS p FROM comp GROUP BY dir"
    return f"WITH m AS ({load}), f AS (SELECT path, dir, sum(tokens) AS load FROM comp GROUP BY path, dir), low AS (SELECT dir, load FROM m ORDER BY load, dir LIMIT 1), c AS (SELECT f.path, m.dir AS target, m.load AS had, f.load AS own, 0 AS far FROM f JOIN m ON f.dir = m.dir UNION ALL SELECT f.path, low.dir, low.load, f.load, 1 FROM f CROSS JOIN low WHERE low.dir <> f.dir) SELECT path, target FROM (SELECT path, target, row_number() OVER (PARTITION BY path ORDER BY CASE WHEN had + own > 2500 THEN 1 ELSE 0 END, far, had, target) AS k FROM c) r WHERE k = 1"


@plan
def split_gate(d):
    """Modules that are worth a split."""
    return f"SELECT dir, {I('sum(tokens)')} AS tokens, count(DISTINCT path) AS files, count(DISTINCT path) > 1 AND sum(tokens) >= 2000 AS divide FROM comp GROUP BY dir"


@plan
def class_caps(d):
    """At most five of a class, shallow paths first; the rest is counted."""
    return "SELECT dir, count(CASE WHEN k <= 5 THEN 1 END) AS kept, count(CASE WHEN k > 5 THEN 1 END) AS omitted, min(CASE WHEN k = 1 THEN id END) AS first_id FROM (SELECT dir, id, row_number() OVER (PARTITION BY dir ORDER BY length(path), id) AS k FROM comp) t GROUP BY dir"


@plan
def route_same_file(d):
    """D03 rule 1: a new component goes where most of its file's tracked ones are."""
    if not d.duck:  # a path's owner is found once, not for each new component
        return "SELECT DISTINCT n.id, b.owner FROM comp n JOIN (SELECT path, kind AS owner, row_number() OVER (PARTITION BY path ORDER BY count(*) DESC, kind) AS k FROM comp WHERE pk % 10 <> 0 GROUP BY path, kind) b ON n.path = b.path WHERE n.pk % 10 = 0 AND b.k = 1"
    return "SELECT id, owner FROM (SELECT n.id, o.kind AS owner, row_number() OVER (PARTITION BY n.id ORDER BY count(*) DESC, o.kind) AS k FROM comp n JOIN comp o ON n.path = o.path AND o.pk % 10 <> 0 WHERE n.pk % 10 = 0 GROUP BY n.id, o.kind) t WHERE k = 1"


@plan
def route_same_dir(d):
    """D03 rule 2: or to the one leaf of its directory."""
    return "SELECT n.id, o.owner FROM comp n JOIN (SELECT path, min(kind) AS owner FROM comp WHERE pk % 10 <> 0 GROUP BY path HAVING count(DISTINCT kind) = 1) o ON n.path = o.path WHERE n.pk % 10 = 0"


@plan
def route_neighbour_majority(d):
    """D03 rule 3, A11: or to the leaf that owns half or more of its neighbours."""
    return "SELECT id, owner FROM (SELECT id, owner, n, sum(n) OVER (PARTITION BY id) AS total, row_number() OVER (PARTITION BY id ORDER BY n DESC, owner) AS k FROM (SELECT e.id, c.dir AS owner, count(*) AS n FROM (SELECT src AS id, dst AS other FROM edge UNION SELECT dst, src FROM edge) e JOIN comp c ON e.other = c.pk GROUP BY e.id, c.dir) v) r WHERE k = 1 AND 2 * n >= total"


# ---- hierarchy


@plan
def owner_map_deepest(d):
    """The deepest module that lists a component; parents list their children's."""
    return "SELECT cid, path FROM (SELECT cid, path, row_number() OVER (PARTITION BY cid ORDER BY depth DESC, path) AS k FROM (SELECT cid, path, 2 AS depth FROM owned JOIN module USING (mk) UNION ALL SELECT cid, parent, 1 FROM owned JOIN module USING (mk)) l) t WHERE k = 1"


@plan
def owned_directly(d):
    """Components that a module owns itself."""
    return f"SELECT path, count(*) AS n, {I('count(DISTINCT cid)')} AS n_distinct FROM owned JOIN module USING (mk) GROUP BY path"


@plan
def ancestors_explode(d):
    """Each component at its module and at every ancestor."""
    return "SELECT node, count(*) AS n FROM (SELECT path AS node, cid FROM owned JOIN module USING (mk) UNION ALL SELECT parent, cid FROM owned JOIN module USING (mk) UNION ALL SELECT '', cid FROM owned JOIN module USING (mk)) t GROUP BY node"


@plan
def preorder(d):
    """Parents before children: a module's place is its parent's first place and its own among its siblings."""
    return "WITH m AS (SELECT parent, path, row_number() OVER (PARTITION BY parent ORDER BY path) AS k FROM module), p AS (SELECT parent, count(*) + 1 AS n FROM module GROUP BY parent), q AS (SELECT a.parent, coalesce(sum(b.n), 0) AS before FROM p a LEFT JOIN p b ON b.parent < a.parent GROUP BY a.parent) SELECT parent AS node, CAST(before + 1 AS BIGINT) AS ord FROM q UNION ALL SELECT m.path, CAST(before + 1 + k AS BIGINT) FROM m JOIN q ON m.parent = q.parent"


@plan
def postorder(d):
    """Children before parents."""
    return "WITH m AS (SELECT parent, path, row_number() OVER (PARTITION BY parent ORDER BY path) AS k FROM module), p AS (SELECT parent, count(*) + 1 AS n FROM module GROUP BY parent), q AS (SELECT a.parent, a.n, coalesce(sum(b.n), 0) AS before FROM p a LEFT JOIN p b ON b.parent < a.parent GROUP BY a.parent, a.n) SELECT parent AS node, CAST(before + n AS BIGINT) AS ord FROM q UNION ALL SELECT m.path, CAST(before + k AS BIGINT) FROM m JOIN q ON m.parent = q.parent"


@plan
def prune_empty_modules(d):
    """Modules that hold, themselves or below, something of weight."""
    return "SELECT node FROM (SELECT path AS node, weight FROM owned JOIN module USING (mk) UNION ALL SELECT parent, weight FROM owned JOIN module USING (mk)) t GROUP BY node HAVING max(weight) > 9900"


@plan
def first_owner_conflicts(d):
    """The first claim of a part by a supplier, and later claims."""
    return "SELECT l_partkey AS part, min(l_suppkey) AS first_owner, count(DISTINCT l_suppkey) - 1 AS later FROM lineitem GROUP BY l_partkey"


@plan
def multi_claims(d):
    """Components that several nodes list."""
    return "SELECT l_partkey AS part, count(DISTINCT l_suppkey) AS owners FROM lineitem GROUP BY l_partkey HAVING count(DISTINCT l_suppkey) > 1"


@plan
def coverage_check(d):
    """Missing, outside and repeated ids of a partition."""
    return "SELECT 'missing' AS fault, count(*) AS n FROM comp WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = pk) UNION ALL SELECT 'outside', count(*) FROM (SELECT DISTINCT l_partkey FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM comp WHERE pk = l_partkey)) o UNION ALL SELECT 'repeated', count(*) FROM (SELECT l_partkey FROM lineitem GROUP BY l_partkey HAVING count(DISTINCT l_suppkey) > 1) r"


@plan
def common_prefix(d):
    """The common start of a module's paths, which is that of its least and its greatest: up to the first place where they differ."""
    at = f"SELECT dir, lo, hi, {d.each('range(1, length(lo) + 1)') if d.duck else 'explode(sequence(1, greatest(1, length(lo))))'} AS i FROM (SELECT dir, min(path) AS lo, max(path) AS hi FROM comp GROUP BY dir) m"
    return f"SELECT dir, substring(lo, 1, CAST(coalesce(min(CASE WHEN substring(lo, CAST(i AS INT), 1) <> substring(hi, CAST(i AS INT), 1) THEN i END) - 1, length(lo)) AS INT)) AS prefix FROM ({at}) t GROUP BY dir, lo"


@plan
def affected_cascade(d):
    """Modules of changed files, their ancestors and the overview."""
    return "WITH hit AS (SELECT DISTINCT path, parent FROM owned JOIN module USING (mk) WHERE weight > 9900) SELECT path AS node, 'module' AS why FROM hit UNION SELECT parent, 'ancestor' FROM hit UNION SELECT 'overview', 'overview' FROM hit"


@plan
def write_set_roles(d):
    """Pages to write, with their roles."""
    return f"SELECT page, {d.joined('role')} AS roles FROM (SELECT DISTINCT b.dir AS page, 'leaf' AS role FROM comp b WHERE b.tokens = 50 UNION SELECT DISTINCT a.dir, 'dependent' FROM edge JOIN comp a ON src = a.pk JOIN comp b ON dst = b.pk WHERE b.tokens = 50 AND a.dir <> b.dir UNION SELECT 'overview', 'ancestor') t GROUP BY page"


# ---- snapshots and maintenance

_SIDE = "SELECT o_custkey AS id, {sig} AS sig, {body} AS body, {deps} AS deps FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey WHERE o_orderdate >= {lo} AND o_orderdate < {hi} GROUP BY o_custkey"


def _snapshots(d) -> str:
    side = lambda lo, hi: _SIDE.format(sig=d.joined("o_orderpriority"), body=d.joined("o_orderstatus"), deps=d.joined("CAST(l_partkey AS STRING)"), lo=f"TIMESTAMP '{lo} 00:00:00'", hi=f"TIMESTAMP '{hi} 00:00:00'")
    return f"WITH old AS ({side('1997-01-01', '1997-07-01')}), new AS ({side('1997-07-01', '1998-01-01')}), diff AS (SELECT coalesce(n.id, o.id) AS id, CASE WHEN o.id IS NULL THEN 'added' WHEN n.id IS NULL THEN 'deleted' WHEN o.sig <> n.sig THEN 'interface' WHEN o.body <> n.body THEN 'body' WHEN coalesce(o.deps, '') <> coalesce(n.deps, '') THEN 'edge' ELSE 'unchanged' END AS change FROM old o FULL OUTER JOIN new n ON o.id = n.id) "


@plan
def graph_diff_classes(d):
    """The class of each changed component."""
    return _snapshots(d) + "SELECT id, change FROM diff WHERE change <> 'unchanged'"


@plan
def graph_diff_counts(d):
    """How many of each class."""
    return _snapshots(d) + "SELECT change, count(*) AS n FROM diff GROUP BY change"


@plan
def edge_delta(d):
    """Dependencies gained and lost by components in both snapshots."""
    e = lambda lo, hi: f"SELECT DISTINCT o_custkey AS id, l_partkey AS dep FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE o_orderdate >= TIMESTAMP '{lo} 00:00:00' AND o_orderdate < TIMESTAMP '{hi} 00:00:00'"
    return f"WITH a AS ({e('1997-01-01', '1997-07-01')}), b AS ({e('1997-07-01', '1998-01-01')}) SELECT coalesce(a.id, b.id) AS id, count(CASE WHEN a.id IS NULL THEN 1 END) AS gained, count(CASE WHEN b.id IS NULL THEN 1 END) AS lost FROM a FULL OUTER JOIN b ON a.id = b.id AND a.dep = b.dep WHERE coalesce(a.id, b.id) IN (SELECT id FROM a) AND coalesce(a.id, b.id) IN (SELECT id FROM b) GROUP BY coalesce(a.id, b.id)"


@plan
def growth_flags(d):
    """Leaves whose new components are a third or more."""
    return _snapshots(d) + "SELECT c_nationkey AS leaf, count(CASE WHEN change = 'added' THEN 1 END) AS entered, count(CASE WHEN change <> 'deleted' THEN 1 END) AS now_n, 100 * count(CASE WHEN change = 'added' THEN 1 END) >= 33 * count(CASE WHEN change <> 'deleted' THEN 1 END) AS flagged FROM diff JOIN customer ON id = c_custkey GROUP BY c_nationkey"


@plan
def leaf_reports(d):
    """What entered, left and changed in each leaf, and its mode."""
    return _snapshots(d) + "SELECT c_nationkey AS leaf, count(CASE WHEN change IN ('interface', 'body', 'edge') THEN 1 END) AS own, count(CASE WHEN change = 'added' THEN 1 END) AS entered, count(CASE WHEN change = 'deleted' THEN 1 END) AS gone, CASE WHEN count(CASE WHEN change <> 'deleted' THEN 1 END) = 0 THEN 'delete' WHEN count(CASE WHEN change <> 'added' THEN 1 END) = 0 THEN 'create' ELSE 'edit' END AS mode FROM diff JOIN customer ON id = c_custkey GROUP BY c_nationkey"


@plan
def active_set(d):
    """Leaves with a change."""
    return _snapshots(d) + "SELECT DISTINCT c_nationkey AS leaf FROM diff JOIN customer ON id = c_custkey WHERE change <> 'unchanged'"


@plan
def fallback_ratio(d):
    """Shares of active and of structural leaves, and whether to start anew."""
    return _snapshots(d) + ", leaf AS (SELECT c_nationkey AS leaf, max(CASE WHEN change <> 'unchanged' THEN 1 ELSE 0 END) AS active, max(CASE WHEN change IN ('added', 'deleted') THEN 1 ELSE 0 END) AS structural FROM diff JOIN customer ON id = c_custkey GROUP BY c_nationkey) ".replace(", leaf", ", leaf", 1) + f"SELECT {I('sum(active)')} AS n_active, {I('sum(structural)')} AS n_structural, count(*) AS n_leaves, 2 * sum(active) >= count(*) OR 10 * sum(structural) >= 3 * count(*) AS start_anew FROM leaf"


# ---- pages


def _links(d) -> str:
    return f"(SELECT page_id, ord, item AS target FROM {d.rows_of(d.find('html', 'href=\"([^\"]*)\"'), 'page_id', 'pages')} x)"


@plan
def page_links(d):
    """Links of each page."""
    return f"SELECT page_id, target, count(*) AS n FROM {_links(d)} l GROUP BY page_id, target"


@plan
def reference_inverse(d):
    """Pages that refer to a target."""
    return f"SELECT target, count(DISTINCT page_id) AS pages, {d.joined('CAST(page_id AS STRING)')} AS ids FROM {_links(d)} l GROUP BY target"


@plan
def stale_links(d):
    """Links to what fewer than five pages know."""
    return f"WITH l AS (SELECT * FROM {_links(d)} x) SELECT DISTINCT page_id, l.target FROM l JOIN (SELECT target FROM l GROUP BY target HAVING count(DISTINCT page_id) < 5) r ON l.target = r.target"


@plan
def first_link_per_section(d):
    """The first link to each target on a page."""
    return f"SELECT page_id, target, min(ord) AS at FROM {_links(d)} l GROUP BY page_id, target"


@plan
def related_pages(d):
    """Five pages with most shared targets. Pages with equal targets are met once as a class, so a common target costs the square of classes, not of pages."""
    return f"WITH l AS (SELECT DISTINCT page_id, target FROM {_links(d)} x), g AS (SELECT page_id, {d.joined('target', chr(9))} AS sig FROM l GROUP BY page_id), c AS (SELECT sig, min(page_id) AS cls FROM g GROUP BY sig), r AS (SELECT DISTINCT c.cls, l.target FROM l JOIN g ON l.page_id = g.page_id JOIN c ON g.sig = c.sig), n AS (SELECT x.cls AS a, y.cls AS b, count(*) AS n FROM r x JOIN r y ON x.target = y.target GROUP BY x.cls, y.cls), of AS (SELECT g.page_id, c.cls, row_number() OVER (PARTITION BY c.cls ORDER BY g.page_id) AS nth FROM g JOIN c ON g.sig = c.sig) SELECT a, b, n FROM (SELECT x.page_id AS a, y.page_id AS b, n.n, row_number() OVER (PARTITION BY x.page_id ORDER BY n.n DESC, y.page_id) AS k FROM of x JOIN n ON x.cls = n.a JOIN of y ON y.cls = n.b AND y.nth <= 6 WHERE x.page_id <> y.page_id) t WHERE k <= 5"


@plan
def plain_text_strip(d):
    """Page text without tags, white space collapsed."""
    return f"SELECT page_id, CAST(length(t) AS BIGINT) AS chars, sha1(t) AS digest FROM (SELECT page_id, trim({d.replaced(d.replaced('html', '<[^>]*>', ' '), '[ \\t\\n\\r]+', ' ')}) AS t FROM pages) p"


@plan
def ignore_precedence(d):
    """User excludes win, defaults yield to the white list, ignored files come last. Here: private hosts, query strings, pages of one kind, numbered paths."""
    user, default, white, ignored = (d.like("url", p) for p in ("/private/|/tmp/", "[?#]|/[0-9]*[13579]$", "/wiki/|/docs?/", "/[0-9]+0$"))
    return f"SELECT page_id, {user} OR (NOT {white} AND {default}) OR {ignored} AS excluded, {user} AS by_user, {white} AS listed FROM pages"


# ---- ledger, sessions, jobs


@plan
def ledger_summary(d):
    """Totals, by phase and by hour of the day, in one pass."""
    return "SELECT phase, hour, count(*) AS n, floor(sum(CAST(seconds AS DECIMAL(18, 4))) * 100) AS centiseconds FROM (SELECT phase, CAST(extract(hour FROM ts) AS BIGINT) AS hour, seconds FROM ledger) l GROUP BY GROUPING SETS ((), (phase), (hour))".replace("floor(sum(CAST(seconds AS DECIMAL(18, 4))) * 100)", "CAST(sum(CAST(floor(seconds * 100) AS BIGINT)) AS BIGINT)")


_PRICES = "(SELECT 'view' AS pp, CAST(2 AS BIGINT) AS price UNION ALL SELECT 'click', 3 UNION ALL SELECT 'purchase', 7)"

_RATES = "(SELECT 'view' AS pp, CAST(1.25 AS DECIMAL(10, 4)) AS rate_in, CAST(0.125 AS DECIMAL(10, 4)) AS rate_cache UNION ALL SELECT 'click', 3, NULL UNION ALL SELECT 'purchase', 15, 1.5)"


@plan
def priced_usage(d):
    """Decimal prices a million tokens; cached tokens by the rate of the cache or else of input; phases without rates stay unknown."""
    return f"SELECT phase, count(*) AS n, CAST(floor(CAST(sum((tokens - cached) * rate_in + cached * coalesce(rate_cache, rate_in)) AS DECIMAL(30, 6)) * 1000 / 1000000 + CAST(0.5 AS DECIMAL(2, 1))) AS BIGINT) AS millis FROM (SELECT phase, CAST(floor(seconds * 1000) AS DECIMAL(18, 0)) AS tokens, CAST(floor(seconds * 250) AS DECIMAL(18, 0)) AS cached FROM ledger) l LEFT JOIN {_RATES} p ON phase = pp GROUP BY phase"


@plan
def ledger_status(d):
    """Complete, partial or unknown."""
    return f"SELECT target, CASE WHEN count(price) = count(*) THEN 'complete' WHEN count(price) > 0 THEN 'partial' ELSE 'unknown' END AS status FROM ledger LEFT JOIN {_PRICES} p ON phase = pp GROUP BY target"


@plan
def eta_throughput(d):
    """What is left, at the pace so far, after each event of a target."""
    return "SELECT target, id, total - k AS remaining, CAST(floor((total - k) * spent / k) AS BIGINT) AS eta FROM (SELECT target, id, row_number() OVER (PARTITION BY target ORDER BY ts, id) AS k, count(*) OVER (PARTITION BY target) AS total, CAST(sum(CAST(floor(seconds) AS BIGINT)) OVER (PARTITION BY target ORDER BY ts, id ROWS UNBOUNDED PRECEDING) AS DOUBLE) AS spent FROM ledger) t"


@plan
def sessions_last_six(d):
    """The last six turns of a session."""
    return "SELECT conv_id, turn, role FROM (SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS k FROM conversations) t WHERE k <= 6"


@plan
def sessions_keep_n(d):
    """The first three turns, after an edit."""
    return "SELECT conv_id, turn, role FROM (SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations) t WHERE k <= 3"


@plan
def sessions_inactivity(d):
    """Sessions end after two hours without an event."""
    return f"SELECT target, CAST(session AS BIGINT) AS session, count(*) AS n, min(ts) AS began FROM (SELECT target, ts, sum(fresh) OVER (PARTITION BY target ORDER BY ts, id ROWS UNBOUNDED PRECEDING) AS session FROM (SELECT target, ts, id, CASE WHEN {d.seconds('ts', 'lag(ts) OVER (PARTITION BY target ORDER BY ts, id)')} <= 7200 THEN 0 ELSE 1 END AS fresh FROM ledger) a) b GROUP BY target, session"


@plan
def sessions_lru(d):
    """The hundred targets seen last."""
    return "SELECT target, seen FROM (SELECT target, max(ts) AS seen, row_number() OVER (ORDER BY max(ts) DESC, target) AS k FROM ledger GROUP BY target) t WHERE k <= 100"


@plan
def job_latest_state(d):
    """The last state of each job."""
    return "SELECT target, phase FROM (SELECT target, phase, row_number() OVER (PARTITION BY target ORDER BY ts DESC, id DESC) AS k FROM ledger) t WHERE k = 1"


@plan
def event_spans(d):
    """Seconds to the next event of a target, 0 for the last."""
    return f"SELECT id, coalesce({d.seconds('lead(ts) OVER (PARTITION BY target ORDER BY ts, id)', 'ts')}, 0) AS span FROM ledger"


@plan
def gap_islands_low_gain(d):
    """Two events of low value in a row."""
    return "SELECT target, min(id) AS stop_at FROM (SELECT target, id, value_low, lag(value_low) OVER (PARTITION BY target ORDER BY ts, id) AS before FROM (SELECT target, id, ts, CASE WHEN seconds < 5 THEN 1 ELSE 0 END AS value_low FROM ledger) a) b WHERE value_low = 1 AND before = 1 GROUP BY target"


@plan
def cache_expiry(d):
    """The newest entry of each key that is not past its time; entries of a key are made when their page is met, a day for each hundred pages."""
    key = "substring(sha256(url), 1, 16)" if d.duck else "substring(sha2(url, 256), 1, 16)"
    return f"SELECT cache_key, max(page_id) AS page, max(age) AS oldest FROM (SELECT {key} AS cache_key, page_id, (SELECT max(page_id) FROM pages) - page_id AS age FROM pages) t WHERE age <= 200 GROUP BY cache_key"


@plan
def rubric_weighted_score(d):
    """Share of good documents of each source, in hundredths of a per cent."""
    return f"SELECT source, count(*) AS n, {d.div('10000 * sum(quality)', 'count(*)')} AS score FROM documents JOIN labels USING (doc_id) GROUP BY source".replace(d.div("10000 * sum(quality)", "count(*)"), I(d.div("10000 * sum(quality)", "count(*)")))


@plan
def rename_candidates_blocked(d):
    """Pairs of one language, of like length, with a Dice score of 0.95 or more on their words. Equal multisets of words meet once, as a class; classes meet on their rarer words: of a class's words, ordered by how many classes hold them, as many come first as leave out no pair."""
    w = f"(SELECT id, {d.each(d.words('text'))} AS w FROM units)"
    sig = f"{d.listed('cw', 'cw', ' ')}"
    return f"""WITH c AS (SELECT id, w, count(*) AS n FROM {w} x GROUP BY id, w), s AS (SELECT id, {sig} AS sig, sum(n) AS total FROM (SELECT id, n, concat(w, ':', CAST(n AS STRING)) AS cw FROM c) y GROUP BY id),
      k AS (SELECT s.sig, u.lang, min(s.id) AS cls, min(total) AS total FROM s JOIN units u ON s.id = u.id GROUP BY s.sig, u.lang), of AS (SELECT s.id, k.cls FROM s JOIN units u ON s.id = u.id JOIN k ON k.sig = s.sig AND k.lang = u.lang),
      m AS (SELECT k.cls, k.lang, k.total, c.w, c.n FROM k JOIN c ON c.id = k.cls), f AS (SELECT w, count(*) AS df FROM m GROUP BY w),
      o AS (SELECT m.*, coalesce(sum(m.n) OVER (PARTITION BY m.cls ORDER BY f.df, m.w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM m JOIN f ON m.w = f.w),
      p AS (SELECT DISTINCT a.cls AS a, b.cls AS b, a.total + b.total AS t FROM o a JOIN o b ON a.w = b.w AND a.lang = b.lang AND a.cls < b.cls WHERE a.before <= a.total - ceil(a.total * CAST(0.95 AS DOUBLE) / CAST(1.05 AS DOUBLE)) + 1 AND b.before <= b.total - ceil(b.total * CAST(0.95 AS DOUBLE) / CAST(1.05 AS DOUBLE)) + 1 AND 100 * least(a.total, b.total) >= 85 * greatest(a.total, b.total)),
      q AS (SELECT a, b FROM p JOIN m x ON x.cls = a JOIN m y ON y.cls = b AND y.w = x.w GROUP BY a, b, t HAVING 200 * sum(least(x.n, y.n)) >= 95 * t)
      SELECT cls AS a, id AS b, 'copy' AS how FROM of WHERE cls <> id UNION ALL SELECT a, b, 'near' FROM q"""
