"""Ranked lexical search: a weighted-field inverted index that is stored, and what is built on its scores."""

from __future__ import annotations

import heapq
import time
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvane.functions import text as T
from corvane.session import discard, shared_dir, stored

# fixed values of the ranking
K1, B = 1.2, 0.75
WEIGHTS = {"title": 4.0, "path": 2.0, "content": 1.0}
PREFIX_WEIGHT, PREFIX_WINDOW = 0.5, 6
STALE, HOP = 0.5, 0.5
PINS = 5
RECHECK_S = 30

#: Postings of a bucket, the most buckets, and minibuckets of terms that are dealt out to them.
BUCKET_ROWS, MOST_BUCKETS, MINIS = 2_000_000, 4096, 4096
#: How many times larger a segment is than the next, at least.
GROWTH = 4
_SIZES = "array<struct<field:string,len:int>>"
_STATE = "n long, total map<string,long>, id_type string, segments array<struct<number:int,rows:long,buckets:int,minis:array<int>,hot:map<string,array<int>>>>"


@dataclass
class Segment:
    """One write of an index: its number, postings, buckets, the bucket of each minibucket, and those of each term that is split."""

    number: int
    rows: int
    buckets: int
    minis: list[int]
    hot: dict[str, list[int]]


def fields(units: DataFrame) -> DataFrame:
    """id, field, len (terms of that field) and term of every occurrence; `units` has id, title, path and content. Null fields are empty."""
    each = F.array(*[F.struct(F.lit(f).alias("field"), T.terms(F.coalesce(F.col(f), F.lit(""))).alias("terms")) for f in WEIGHTS])
    return units.select("id", F.inline(each)).select("id", "field", F.size("terms").alias("len"), F.explode("terms").alias("term"))


def counts(units: DataFrame) -> DataFrame:
    """id and fields (field, len, and terms: each term with its freq) of each row of `units`, as `fields` gives them one by one; fields without terms are left out. The terms of a field are sorted, and a term's
    freq is the distance to the next one's start."""
    starts = lambda s: F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: (i == 0) | (F.get(s, i) != F.get(s, i - 1)))
    runs = lambda s, at: F.transform(at, lambda p, k: F.struct(F.get(s, p).alias("term"), (F.coalesce(F.get(at, k + 1), F.size(s)) - p).cast("long").alias("freq")))
    bound = lambda value, of: F.get(F.transform(F.array(value), of), F.lit(0))  # noqa: E731  so that a value used more than once is made once
    of = lambda f: bound(F.sort_array(T.terms(F.coalesce(F.col(f), F.lit("")))), lambda s: F.struct(F.lit(f).alias("field"), F.size(s).alias("len"), bound(starts(s), lambda at: runs(s, at)).alias("terms")))
    each = [of(f) for f in WEIGHTS]
    return units.select("id", F.filter(F.array(*each), lambda f: f["len"] > 0).alias("fields"))


def query_terms(spark: SparkSession, text: str) -> list[str]:
    """The terms of a question, by the rules of the index, once each."""
    return list(dict.fromkeys(spark.range(1).select(T.terms(F.lit(text)).alias("t")).first()["t"]))


class Index:
    """Postings in segments, each in buckets of like size, sorted by term. A query reads the buckets of its terms alone.

    A segment holds the postings of the units it brought, their terms by unit, its words with what it adds to (or takes from) the number of units that hold them, and the ids that
    it replaces or removes in earlier segments. `update` writes one segment from the new units and the old terms of the units they replace: no other text is read. Numbers of units and terms are kept
    by adding and taking away. Small segments at the end are merged into one as they grow (each is GROWTH times smaller than the one before), so their number stays logarithmic.
    A state is one small file that names the segments; it counts once it is complete, so an update that broke off changes nothing.

    Buckets: the number of postings of each minibucket of terms is measured first. A term that has more than half a bucket's share is split by units; all pieces are then dealt
    out to buckets, the largest first, so that every task writes and reads about as much, whatever the distribution of terms.

    Defined cases: null fields are empty; units without terms (or no units) are counted, and have no postings; of units that share an id in one batch all count as that unit's postings.
    """

    _open: dict[tuple[str, str], tuple[Index, object, float]] = {}

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/states")
        fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        names = sorted(x.getPath().getName() for x in fs.listStatus(at))
        done = [x for x in names if fs.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/states/{x}/_SUCCESS"))]
        row = spark.read.schema(_STATE).json(f"{path}/states/{done[-1]}").first()
        self.state, self.n, self.total, self.id_type = int(done[-1]), row["n"], row["total"] or {}, row["id_type"]
        self.segments = [Segment(**x.asDict()) for x in row["segments"]]
        self.average = {f: max(1.0, (self.total.get(f) or 0) / max(1, self.n)) for f in WEIGHTS}

    # ---- writing

    @classmethod
    def build(cls, units: DataFrame, path: str | None = None, buckets: int | None = None) -> Index:
        """Writes the index of `units`; its size is that of the texts, a query's cost that of its terms."""
        spark = units.sparkSession
        path = path or f"{shared_dir(spark)}/index-{time.time_ns():x}"
        id_type = units.schema["id"].dataType.simpleString()
        segment, n, total = cls._segment(units, path, 0, id_type, buckets)
        cls._commit(spark, path, 0, [segment], n, total, id_type)
        return cls(spark, path)

    @classmethod
    def _segment(cls, units: DataFrame, path: str, number: int, id_type: str, buckets: int | None = None, gone: DataFrame | None = None, old: DataFrame | None = None) -> tuple[Segment, int, dict[str, int]]:
        """Writes the segment `number`; it, its number of units and its terms by field. `gone` (id): what it takes the place of; `old` (term, df): what those held."""
        spark, at = units.sparkSession, f"{path}/segment-{number:06d}"
        counted = stored(counts(units), "counted")  # occurrences are counted where their unit is read: only postings move, once, to their buckets
        posted = counted.select("id", F.inline("fields")).select("id", "field", "len", F.inline("terms"))
        dealt = cls._dealt(posted, buckets)
        cls._write_postings(posted, dealt, at)
        cls._by_unit(counted).write.mode("overwrite").parquet(f"{at}/units")
        by_unit = spark.read.schema(f"id {id_type}, terms array<string>").parquet(f"{at}/units")
        words = by_unit.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
        if old is not None:
            words = words.unionByName(old.select("term", (-F.col("df")).alias("df"))).groupBy("term").agg(F.sum("df").alias("df")).filter("df <> 0")
        words.orderBy("term").write.mode("overwrite").parquet(f"{at}/words")
        (gone if gone is not None else units.select("id").limit(0)).select("id").distinct().write.mode("overwrite").parquet(f"{at}/gone")
        total = {r["field"]: r["n"] for r in counted.select(F.inline("fields")).groupBy("field").agg(F.sum("len").alias("n")).collect()}  # a row per field
        n = by_unit.count()
        discard(counted)
        return Segment(number, dealt["rows"], dealt["buckets"], dealt["minis"], dealt["hot"]), n, total

    @staticmethod
    def _by_unit(counted: DataFrame) -> DataFrame:
        """id, terms (each once) and sizes of the units in `counted`; rows that share an id are one unit, the others stay where they are."""
        each = counted.filter("id IS NOT NULL").select("id", F.array_distinct(F.flatten(F.transform("fields", lambda f: f["terms"]["term"]))).alias("terms"), F.transform("fields", lambda f: F.struct(f["field"].alias("field"), f["len"].alias("len"))).cast(_SIZES).alias("sizes"))
        none = counted.filter("id IS NULL").select("id").distinct().select("id", F.array().cast("array<string>").alias("terms"), F.array().cast(_SIZES).alias("sizes"))
        twice = counted.filter("id IS NOT NULL").groupBy("id").count().filter("count > 1").select("id")
        if twice.isEmpty():
            return each.unionByName(none)
        same = each.join(twice, "id", "left_semi")
        sizes = same.select("id", F.inline("sizes")).groupBy("id", "field").agg(F.sum("len").cast("int").alias("len")).groupBy("id").agg(F.collect_list(F.struct("field", "len")).cast(_SIZES).alias("sizes"))
        terms = same.groupBy("id").agg(F.array_distinct(F.flatten(F.collect_list("terms"))).alias("terms"))
        merged_ = terms.join(sizes, "id", "left").select("id", "terms", F.coalesce("sizes", F.array().cast(_SIZES)).alias("sizes"))
        return each.join(twice, "id", "left_anti").unionByName(merged_).unionByName(none)

    @staticmethod
    def _dealt(posted: DataFrame, buckets: int | None) -> dict:
        """How postings (term) are dealt out: the bucket of each minibucket of terms, and the buckets of each term that is split; from counts of at most MINIS minibuckets, and of the terms above half a bucket (twice as many as buckets at the most)."""
        mini = F.pmod(F.xxhash64("term"), F.lit(MINIS)).cast("int")
        by_term = stored(posted.groupBy("term").agg(F.count("*").alias("n")).withColumn("mini", mini), "terms")
        rows = by_term.agg(F.sum("n")).first()[0] or 0
        buckets = buckets or max(1, min(MOST_BUCKETS, -(-rows // BUCKET_ROWS)))
        half = max(1, rows // (2 * buckets))
        hot = {r["term"]: r["n"] for r in by_term.filter(F.col("n") > half).collect()} if buckets > 1 else {}
        pieces = [(r["n"], ("mini", r["mini"], 0)) for r in by_term.filter(~F.col("term").isin(list(hot)) if hot else F.lit(True)).groupBy("mini").agg(F.sum("n").alias("n")).collect()]
        for term, n in hot.items():
            k = -(-n // half)
            pieces += [(n / k, ("hot", term, i)) for i in range(k)]
        heap = [(0, b) for b in range(buckets)]
        minis, split = {}, {t: [] for t in hot}
        for n, (kind, key, i) in sorted(pieces, key=lambda x: (-x[0], str(x[1]))):
            size, b = heapq.heappop(heap)
            heapq.heappush(heap, (size + n, b))
            if kind == "mini":
                minis[key] = b
            else:
                split[key].append(b)
        discard(by_term)
        return {"rows": int(rows), "buckets": buckets, "minis": [minis.get(m, 0) for m in range(MINIS)], "hot": split}

    @staticmethod
    def _write_postings(posted: DataFrame, dealt: dict, at: str) -> None:
        spark = posted.sparkSession
        bucket = F.element_at(F.lit(dealt["minis"]), F.pmod(F.xxhash64("term"), F.lit(MINIS)).cast("int") + 1)
        rows = posted
        if dealt["hot"]:
            split = F.broadcast(spark.createDataFrame([(t, b) for t, b in dealt["hot"].items()], "term string, _to array<int>"))
            rows = posted.join(split, "term", "left")
            bucket = F.when(F.col("_to").isNotNull(), F.element_at("_to", F.pmod(F.xxhash64("id"), F.size("_to")).cast("int") + 1)).otherwise(bucket)
        rows = rows.withColumn("bucket", bucket.cast("int")).select("id", "field", "len", "term", "freq", "bucket")
        rows.repartitionById(dealt["buckets"], F.col("bucket")).sortWithinPartitions("bucket", "term").write.partitionBy("bucket").mode("overwrite").parquet(f"{at}/postings")

    @staticmethod
    def _commit(spark: SparkSession, path: str, state: int, segments: list[Segment], n: int, total: dict[str, int], id_type: str) -> None:
        spark.createDataFrame([(n, total, id_type, [x.__dict__ for x in segments])], _STATE).coalesce(1).write.mode("overwrite").json(f"{path}/states/{state:08d}")

    def update(self, units: DataFrame, removed: DataFrame | None = None) -> Index:
        """The index after `units` came (in place of those with their ids) and `removed` (id) went. Reads the texts of `units` alone."""
        spark = self.spark
        units = stored(units.select("id", *WEIGHTS), "units")
        ids = units.select("id") if removed is None else units.select("id").union(removed.select("id"))
        before = stored(self.units().join(ids.distinct(), "id", "left_semi"), "before")
        old = before.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
        number = self.segments[-1].number + 1
        segment, n, total = self._segment(units, self.path, number, self.id_type, gone=before.select("id"), old=old)
        lost = {r["field"]: r["n"] for r in before.select(F.inline("sizes")).groupBy("field").agg(F.sum("len").alias("n")).collect()}
        fields_ = {f: (self.total.get(f) or 0) + total.get(f, 0) - (lost.get(f) or 0) for f in WEIGHTS}
        n_before = before.count()
        segments = [*self.segments, segment]
        self._commit(spark, self.path, self.state + 1, segments, self.n + n - n_before, fields_, self.id_type)
        discard(units, before)
        out = Index(spark, self.path)
        while len(out.segments) > 2 and out.segments[-1].rows * GROWTH > out.segments[-2].rows:
            out = out.merged(len(out.segments) - 2)
        return out

    def merged(self, first: int) -> Index:
        """The index with its segments from the place `first` on as one; texts are not read."""
        spark, part = self.spark, self.segments[first:]
        number = part[-1].number + 1
        at = f"{self.path}/segment-{number:06d}"
        posted = stored(self._live(reduce(DataFrame.unionByName, [self._postings(x) for x in part]), part).select("id", "field", "len", "term", "freq"), "posted")
        dealt = self._dealt(posted, None)
        self._write_postings(posted, dealt, at)
        self._live(reduce(DataFrame.unionByName, [self._units(x) for x in part]), part).select("id", "terms", "sizes").write.mode("overwrite").parquet(f"{at}/units")
        reduce(DataFrame.unionByName, [self._words(x) for x in part]).groupBy("term").agg(F.sum("df").alias("df")).filter("df <> 0").orderBy("term").write.mode("overwrite").parquet(f"{at}/words")
        reduce(DataFrame.unionByName, [self._gone(x) for x in part]).select("id").distinct().write.mode("overwrite").parquet(f"{at}/gone")
        discard(posted)
        segments = [*self.segments[:first], Segment(number, dealt["rows"], dealt["buckets"], dealt["minis"], dealt["hot"])]
        self._commit(spark, self.path, self.state + 1, segments, self.n, self.total, self.id_type)
        return Index(spark, self.path)

    @classmethod
    def fresh(cls, units: DataFrame, name: str, stamp) -> Index:
        """The index of `units` as `name`: built once, looked at again after RECHECK_S seconds, and built anew when `stamp()` has changed."""
        spark = units.sparkSession
        key = (spark.sparkContext.applicationId, name)
        held = cls._open.get(key)
        if held and time.monotonic() - held[2] < RECHECK_S:
            return held[0]
        now = stamp()
        index = held[0] if held and held[1] == now else cls.build(units)
        cls._open[key] = (index, now, time.monotonic())
        return index

    # ---- reading

    def _read(self, segment: Segment, kind: str, schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.path}/segment-{segment.number:06d}/{kind}").withColumn("_segment", F.lit(segment.number))

    def _postings(self, x: Segment) -> DataFrame:
        return self._read(x, "postings", f"id {self.id_type}, field string, len int, term string, freq long, bucket int")

    def _units(self, x: Segment) -> DataFrame:
        return self._read(x, "units", f"id {self.id_type}, terms array<string>, sizes {_SIZES}")

    def _words(self, x: Segment) -> DataFrame:
        return self._read(x, "words", "term string, df long").drop("_segment")

    def _gone(self, x: Segment) -> DataFrame:
        return self._read(x, "gone", f"id {self.id_type}")

    def _live(self, rows: DataFrame, segments: list[Segment] | None = None) -> DataFrame:
        """`rows` (id, _segment) without those of units that a later segment replaced or removed."""
        later = [self._gone(x) for x in (segments or self.segments)[1:]]
        if not later:
            return rows
        last = reduce(DataFrame.unionByName, later).groupBy("id").agg(F.max("_segment").alias("_gone"))
        return rows.join(last, "id", "left").filter("_gone IS NULL OR _segment >= _gone").drop("_gone")

    def units(self) -> DataFrame:
        """id, terms (each once) and sizes (field, len) of all units."""
        return self._live(reduce(DataFrame.unionByName, [self._units(x) for x in self.segments])).drop("_segment")

    def vocabulary(self) -> DataFrame:
        """term and df (units that hold it in any field)."""
        if len(self.segments) == 1:
            return self._words(self.segments[0])
        return reduce(DataFrame.unionByName, [self._words(x) for x in self.segments]).groupBy("term").agg(F.sum("df").alias("df")).filter("df > 0")

    def postings(self, terms: list[str]) -> DataFrame:
        """id, field, len, term and freq of these terms, from their buckets alone."""
        minis = {r[0]: r[1] for r in self.spark.createDataFrame([(t,) for t in terms], "term string").select("term", F.pmod(F.xxhash64("term"), F.lit(MINIS)).cast("int")).collect()} if terms else {}
        parts = []
        for x in self.segments:
            buckets = sorted({b for t in terms for b in (x.hot.get(t) or [x.minis[minis[t]]])})
            parts.append(self._postings(x).filter(F.col("bucket").isin(buckets or [-1]) & F.col("term").isin(terms)))
        return self._live(reduce(DataFrame.unionByName, parts)).select("id", "field", "len", "term", "freq")

    def expanded(self, query: list[str]) -> dict[str, tuple[float, int]]:
        """Weight and df by term: query terms that exist; for others of three letters or more, of the PREFIX_WINDOW words from it on those it begins, at half weight."""
        words = self.vocabulary()
        out = {r["term"]: (1.0, r["df"]) for r in words.filter(F.col("term").isin(list(query))).collect()} if query else {}
        # words that a query word begins follow it in order, so the first of them are those of the window
        look = [words.filter(F.col("term").startswith(q)).orderBy("term").limit(PREFIX_WINDOW).withColumn("q", F.lit(q)) for q in dict.fromkeys(query) if q not in out and len(q) >= 3]
        for r in reduce(DataFrame.unionByName, look).collect() if look else []:  # PREFIX_WINDOW rows a word
            if r["term"].startswith(r["q"]):
                out.setdefault(r["term"], (PREFIX_WEIGHT, r["df"]))
        return out

    def scores(self, query: list[str], allowed: DataFrame | None = None) -> DataFrame:
        """id and score of the units that hold a query term. Statistics are over all units; `allowed` (id) picks among them."""
        wanted = self.expanded(query)
        spark = self.spark
        idf = spark.createDataFrame([(t, w, d) for t, (w, d) in wanted.items()], "term string, weight double, df long").select("term", (F.col("weight") * F.ln(1 + (F.lit(self.n) - F.col("df") + 0.5) / (F.col("df") + 0.5))).alias("idf"))
        of = lambda values: F.create_map(*[x for f, v in values.items() for x in (F.lit(f), F.lit(float(v)))])
        norm = (1 - B) + F.lit(B) * F.col("len") / F.element_at(of(self.average), F.col("field"))
        tf = self.postings(list(wanted)).groupBy("id", "term").agg(F.sum(F.element_at(of(WEIGHTS), F.col("field")) * F.col("freq") / norm).alias("tf"))
        out = tf.join(F.broadcast(idf), "term").groupBy("id").agg(F.sum(F.col("idf") * F.col("tf") / (K1 + F.col("tf"))).alias("score")).filter("score > 0")
        return out if allowed is None else out.join(allowed.select("id"), "id", "left_semi")


def of_kind(units: DataFrame, kinds: str = "all") -> DataFrame:
    """Units that are documents (kind section), code, or all."""
    if kinds not in ("docs", "code", "all"):
        raise ValueError(f"kinds is docs, code or all, not {kinds!r}")
    return units if kinds == "all" else units.filter((F.col("kind") == "section") == (kinds == "docs"))


def top(ranked: DataFrame, k: int) -> DataFrame:
    """The k best, ties by id."""
    return ranked.withColumn("score", F.round("score", 6)).orderBy(F.col("score").desc(), "id").limit(k)


def discounted(ranked: DataFrame, stale: DataFrame) -> DataFrame:
    """Scores of stale units halved; to be cut afterwards."""
    return ranked.join(stale.select("id").distinct().withColumn("_stale", F.lit(STALE)), "id", "left").select("id", (F.col("score") * F.coalesce("_stale", F.lit(1.0))).alias("score"))


def fused(parts: list[tuple[DataFrame, float]]) -> DataFrame:
    """The largest weighted score of a unit over several rankings."""
    return reduce(DataFrame.unionByName, [p.select("id", (F.col("score") * w).alias("score")) for p, w in parts]).groupBy("id").agg(F.max("score").alias("score"))


def merged(parts: list[DataFrame]) -> DataFrame:
    """Candidate lists (id, score, via: array, hits: array) as one: the largest score, every way it was found, three hits from the first lists on."""
    rows = reduce(DataFrame.unionByName, [p.select("id", "score", "via", "hits", F.lit(i).alias("_list")) for i, p in enumerate(parts)])
    order = F.array_sort(F.collect_list(F.struct("_list", "via", "hits")))
    return rows.groupBy("id").agg(F.max("score").alias("score"), order.alias("_all")).select("id", "score", F.array_sort(F.array_distinct(F.flatten("_all.via"))).alias("via"), F.slice(F.flatten("_all.hits"), 1, 3).alias("hits"))


def pinned(ranked: DataFrame, units: DataFrame, names: list[str], k: int) -> DataFrame:
    """Units that bear a name of the question come first, PINS at most: whole qualified names, then classes and functions, then public names, then what
    is no test, then by score; their scores are above all others. The rest follows by score; k in all. `units` has id, name, qualified, kind and file."""
    wanted = units.filter(F.col("name").isin(names) | F.col("qualified").isin(names)).select("id", "name", "qualified", "kind", "file")
    best = ranked.agg(F.max("score").alias("_top"))
    keys = [F.when(F.col("qualified").isin(names), 0).otherwise(1), F.when(F.col("kind").isin("class", "function"), 0).otherwise(1), F.when(F.col("name").startswith("_"), 1).otherwise(0), F.when(is_test_path(F.col("file")), 1).otherwise(0), -F.coalesce("score", F.lit(0.0)), F.col("id")]
    first = wanted.join(ranked, "id", "left").orderBy(*keys).limit(PINS)
    place = F.row_number().over(Window.orderBy(*keys))  # of PINS rows
    pins = first.withColumn("_place", place).crossJoin(F.broadcast(best)).select("id", (F.coalesce("_top", F.lit(0.0)) + 1 + PINS - F.col("_place")).alias("score"))
    return top(pins.unionByName(ranked.select("id", "score").join(pins.select("id"), "id", "left_anti")), k)


def is_test_path(path):
    """Whether a path is of tests, by its folders or its file's name, in any case."""
    # fixed values: folders and endings of tests
    return F.lower(path).rlike(r"(^|/)(test|tests|__tests__|spec|specs)/|(^|/)test_[^/]*$|(_test\.py|\.test\.js|\.test\.ts|\.spec\.js|\.spec\.ts|_test\.go)$")


def reranked(candidates: DataFrame) -> DataFrame:
    """`candidates` (id, score, hits, tokens) by relevance, grep hits and density; the best score is one broadcast number."""
    best = candidates.agg(F.max("score").alias("_best"))
    return candidates.crossJoin(F.broadcast(best)).withColumn("priority", F.when(F.col("_best") > 0, F.col("score") / F.col("_best")).otherwise(0.0) + F.when(F.col("hits") > 0, 0.6).otherwise(0.0) + 0.3 / (1 + F.col("tokens") / 800.0)).drop("_best")


def frontier(seeds: DataFrame, neighbours: DataFrame, per_hop: int = 10, most: int = 30) -> DataFrame:
    """The best seeds pass half their score to neighbours not seen; id and score, `most` of them."""
    near = top(seeds, per_hop).join(neighbours, F.col("id") == F.col("src")).groupBy("dst").agg(F.max("score").alias("s")).select(F.col("dst").alias("id"), (F.col("s") * HOP).alias("score"))
    return top(seeds.unionByName(near.join(seeds, "id", "left_anti")), most)
