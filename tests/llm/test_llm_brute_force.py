"""The operators against brute force, and cases that once went wrong."""

import hashlib
import itertools
import json
import random
import zlib
from array import array
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.llm import chat, exact_dedup, fingerprints, lm_score, near_dedup, packing, quality, queries, token_counts, token_output
from corvane.llm.common import ChunkEncoder, _Kept, Room, scratch, tokenizer_path

SF = "/root/testdata/sf0.001"
TWO = "doc_id long, text string"


def texts(spark, rows):
    return spark.createDataFrame(rows, TWO)


# ---- 1: token counts


def test_a_batch_committed_during_compaction_counts_once(spark):
    rollup = token_counts.Rollup(spark)
    one = lambda i: token_counts.signed(token_counts.counted(spark.createDataFrame([(i, "a b", "s", "en")], "doc_id long, text string, source string, lang string")), 1)
    rollup.commit("a", one(1))
    sums = rollup._sums
    rollup._sums = lambda *state: (rollup.commit("b", one(2)), sums(*state))[1]
    rollup.compact()
    rollup._sums = sums
    words = lambda: {r.version: r.n_tokens for r in rollup.totals().collect()}["words-1"]
    assert words() == 4 and rollup.committed() == {"a", "b"}
    rollup.compact()
    rollup.compact()
    assert words() == 4 and rollup._folders("deltas") == [] and len(rollup._folders("base")) == 2
    assert not rollup.commit("a", one(1)) and words() == 4


def test_counts_by_vocabulary_and_clashing_columns(spark):
    from tokenizers import Tokenizer

    path = tokenizer_path("byte_bpe_50k.json")
    rows = [(1, "Hello there, world", "s", "en", "x", 7), (None, None, None, None, None, None), (2, "", "s", "en", "x", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, version string, n_tokens int")
    theirs = Tokenizer.from_file(path)
    got = {r.doc_id: (r.version, r.n_tokens) for r in token_counts.counted_by_vocabulary(docs, "bytes-50k", path).collect()}
    assert got == {i: ("bytes-50k", len(theirs.encode(t or "", add_special_tokens=False).ids)) for i, t, *_ in rows}
    assert {(r.doc_id, r.version): r.n_tokens for r in token_counts.counted(docs).collect()}[1, "words-1"] == 3


# ---- 2: fingerprints


def _words(parts):
    """The lanes of a multiset, as 64-bit words, by Python."""
    import xxhash

    out = [[0] * 4 for _ in range(fingerprints.WORDS)]
    for p in parts:
        for h in range(fingerprints.HASHES):
            x = xxhash.xxh64_intdigest(p.encode(), xxhash.xxh64_intdigest(h.to_bytes(4, "little"), 42))
            for j in range(4):
                for lane in range(4):
                    at = out[4 * h + j]
                    at[lane] = (at[lane] + (x >> (4 * j + 16 * lane) & 15)) % 65536
    return out


def test_fingerprints_against_brute_force(spark):
    rows = [(1, "One. Two!\nThree"), (4, None), (5, "x" * 50 + "\n" * 2500 + "é"), (7, "One. Two!\nThree"), (9, "ß"), (12, "a. b. c. d")]
    by = [t or "" for _, t in rows]
    got = {r.doc_id: r for r in fingerprints.compare(texts(spark, rows)).collect()}
    half = lambda parts: f"{len(parts):08X}" + "".join(f"{sum(v << 16 * k for k, v in enumerate(w)):016X}" for w in _words(parts))
    show = lambda t: half(t.split("\n")) + half(__import__("re").split(fingerprints.ENDS, t))
    centred = lambda t: np.array([v - 7.5 * len(s) for s in [[p for p in __import__("re").split(fingerprints.ENDS, t)]] for w in _words(s) for v in w])
    for i, (doc_id, _) in enumerate(rows):
        t, follow = by[i], by[(i + 1) % len(by)]
        k = len(t) // 4
        edited = t[: len(t) - k] + follow[:k]
        r = got[doc_id]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert (r.fingerprint, r.edited_fingerprint) == (show(t), show(edited))
        for near, other in ((r.near_edited, edited), (r.near_next, follow)):
            a, b = centred(t), centred(other)
            want = 1.0 if show(t) == show(other) else max(0.0, min(1.0, a @ b / np.sqrt((a @ a) * (b @ b))))
            assert near == pytest.approx(want, abs=1e-6)


def test_fingerprints_of_repeated_and_missing_ids(spark):
    rows = texts(spark, [(1, "a"), (2, "a"), (2, "b\nc"), (None, "abcd"), (2, "b\nc")])
    out = fingerprints.compare(rows).collect()
    assert len(out) == 5 and {r.near_next for r in out if r.doc_id is None} == {None}
    assert [r.near_next for r in out if r.doc_id == 1] == [1.0]  # the first row of the next id
    assert {r.edited_sha256 for r in out if r.doc_id is None} == {hashlib.sha256(b"abc").hexdigest()}


# ---- 3: near copies


def test_hubs_on_either_side_are_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "SALT_ROWS", 3)
    rng = random.Random(11)
    base = [f"w{i}" for i in range(80)]
    rows = [(i, " ".join(base[:i % 40] + [f"x{rng.random()}"] + base[i % 40 + 1 :])) for i in range(60)] + [(1000, " ".join(base))]
    got = near_dedup.mark(texts(spark, rows), 2).collect()
    assert {r.component_id for r in got} == {0} and len(got) == 61
    pairs = spark.createDataFrame([(i, 1000) for i in range(60)], "a long, b long")
    payload = spark.createDataFrame([(1000, "p")], "b long, v string")
    assert near_dedup.beside(pairs, "b", payload).select("a", "v").distinct().count() == 60


def test_near_dedup_keeps_columns_and_odd_rows(spark):
    t = " ".join(f"w{i}" for i in range(30))
    rows = [(3, t, 1, 2, "a"), (7, t + " tail", 1, 2, "b"), (None, t, 0, 0, None), (8, "other words entirely here now", 1, 1, "c"), (8, t, 1, 1, "d"), (9, None, None, None, None), (9, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, node long, key long, component_id string")
    kept = near_dedup.deduplicate(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id or -1) for r in kept.collect()) == [-1, 3, 9, 9]  # 8 is one document, linked by its second text
    got = {r.doc_id: r.component_id for r in near_dedup.mark(docs).collect()}
    assert got[7] == got[8] == 3 and got[None] is None
    assert near_dedup.deduplicate(docs.limit(0)).count() == 0


# ---- 4: quality


def test_scores_are_exact_votes(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    model = quality.fit(docs, labels.filter(quality.remainder(4) != 2))
    rows = {r.doc_id: r.text for r in docs.filter("doc_id % 7 = 0").collect()}
    got = {r.doc_id: r.score for r in quality.score(docs.filter("doc_id % 7 = 0"), model).collect()}
    for i, t in rows.items():
        x = quality.unit(quality.weighted(quality.counts_of(t or "")[None], model["idf"]) @ model["basis"])[0]
        cosine = model["latent"] @ x
        near = sorted(range(len(cosine)), key=lambda k: -cosine[k])[: quality.NEIGHBOURS]
        w = np.clip(cosine[near].astype(float), 1e-6, 1) ** quality.SHARPNESS * model["votes"][near]
        assert got[i] == pytest.approx(float((w * model["y"][near]).sum() / w.sum()), abs=2e-2)
    held = {r.doc_id: r.quality for r in labels.filter(quality.remainder(4) == 2).collect()}
    scores = {r.doc_id: r.score for r in quality.score(docs.filter(F.col("doc_id").isin(list(held))), model).collect()}
    assert np.mean([(scores[i] >= quality.THRESHOLD) == (y == 1) for i, y in held.items()]) > 0.9


def test_quality_of_ties_and_missing_ids(spark):
    train = texts(spark, [(i, "same text here") for i in range(10)])
    labels = spark.createDataFrame([(i, i % 2) for i in range(10)] + [(3, 0)], "doc_id long, quality int")
    model = quality.fit(train, labels)
    assert {round(r.score, 6) for r in quality.score(train, model).collect()} == {0.5}
    assert quality.score(texts(spark, [(None, "same text here"), (None, None)]), model).count() == 2


# ---- 5: token output


@pytest.mark.parametrize("encoding", ["dictionary", "delta"])
def test_token_files(spark, encoding):
    from tokenizers import Tokenizer

    rng = random.Random(1)
    rows = [(rng.choice([None, 1, 1, 2, 3, 5]), rng.choice([None, "", "a b", "b a", "Hello, world", "x" * 300 + " y" * 900])) for _ in range(60)]
    at = scratch(spark, "tokens")
    token_output.write_tokens(texts(spark, rows), at, encoding, files=3)
    theirs = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    want, start = [], 0
    for i, t in order:
        ids = [*theirs.encode(t or "", add_special_tokens=False).ids, token_output.END_ID]
        want.append((i, start, len(ids), zlib.crc32(array("I", ids).tobytes())))
        start += len(ids)
    assert [tuple(r) for r in token_output.token_spans(spark, at).orderBy("start").collect()] == want
    import pyarrow.parquet as pq

    spark.conf.get("spark.sql.shuffle.partitions")
    for f in spark.read.parquet(at).inputFiles():
        meta = pq.ParquetFile(f.removeprefix("file://")).metadata
        columns = {meta.row_group(0).column(k).path_in_schema.split(".")[0]: meta.row_group(0).column(k) for k in range(meta.num_columns)}
        found = set(columns["tokens"].encodings)
        assert "DELTA_BINARY_PACKED" in found if encoding == "delta" else {"PLAIN_DICTIONARY", "RLE_DICTIONARY"} & found, found
        assert columns["doc_id"].has_offset_index and columns["doc_id"].has_column_index
        assert meta.row_group(0).total_byte_size <= token_output.ROW_GROUP_BYTES * 1.1
    plan = token_output.read_tokens(spark, at, [2])._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(doc_id, [2])" in plan or "EqualTo(doc_id,2)" in plan
    assert "array" not in spark.read.schema(token_output.SCHEMA).parquet(at).select("doc_id", "n_tokens")._jdf.queryExecution().executedPlan().toString().split("ReadSchema")[1]


def test_stores_are_bounded_by_bytes():
    room = Room(10_000)
    kept = _Kept(lambda k: b"\0" * 4, room)
    for i in range(1000):
        assert kept[f"k{i}"] == b"\0" * 4
    assert 10 < len(kept) < 60
    long = _Kept(lambda k: b"", Room(1 << 20))
    assert long["x" * 10_000] == b"" and not long
    path = tokenizer_path("byte_bpe_50k.json")
    tight, wide = ChunkEncoder(path, 3000), ChunkEncoder(path)
    t = " ".join(random.Random(5).choice(["some", "words", "again,", "é!", "w" * 200]) for _ in range(500))
    assert tight.encode(t) == wide.encode(t)


# ---- 6: LM scoring


def test_one_splitting_serves_training_and_scoring(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").union(texts(spark, [(None, "a b"), (None, None), (5, "")]))
    learn = F.coalesce(quality.remainder(3) != 1, F.lit(True))
    apart = lm_score.score(docs, lm_score.train(docs.filter(learn)))
    both = lm_score.train_and_score(docs, learn).drop("learn")
    show = lambda df: sorted((r.doc_id or -1, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 6)) for r in df.collect())
    assert show(apart) == show(both) and both.count() == docs.count()


# ---- 7: packing


def _optimum(sizes, capacity):
    """The least number of sequences, by trying all."""
    best = len(sizes)

    def go(rest, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if not rest:
            best = len(rooms)
            return
        w, seen = rest[0], set()
        for i, room in enumerate(rooms):
            if room >= w and room not in seen:
                seen.add(room)
                go(rest[1:], [*rooms[:i], room - w, *rooms[i + 1 :]])
        go(rest[1:], [*rooms, capacity - w])

    go(sorted(sizes, reverse=True), [])
    return best


def test_dominance_keeps_the_optimum():
    rng = random.Random(9)
    for _ in range(150):
        capacity = rng.choice([10, 17, 30])
        sizes = [rng.randint(1, capacity) for _ in range(rng.randint(1, 9))]
        least = _optimum(sizes, capacity)
        left = dict(Counter(sizes))
        fixed = packing.dominating(left, capacity)
        rest = [w for w, n in left.items() for _ in range(n)]
        assert sum(n for _, n in fixed) + _optimum(rest, capacity) == least
        used = sum(n for _, n in packing.reduce_and_fit(dict(Counter(sizes)), capacity))
        assert least <= used <= least * 11 / 9 + 1


def test_packing_against_the_library(spark, monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(packing, "SALT_ROWS", 2)  # many tasks for a length
    theirs = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    rows = [(i, "a b c") for i in range(9)] + [(20, None), (21, "x " * 31), (22, "x " * 32), (23, "y " * 100), (None, "q")]
    got = packing.pack(texts(spark, rows), capacity=32).collect()
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    for i, t in rows:
        ids = [*theirs.encode(t or "", add_special_tokens=False).ids, 0]
        parts = [ids[k : k + 32] for k in range(0, len(ids), 32)]
        assert [(r.piece, r.start, r.length, r.ids_crc32) for r in sorted(by[i], key=lambda r: r.piece)] == [(k, 32 * k, len(p), zlib.crc32(array("I", p).tobytes())) for k, p in enumerate(parts)]
    places = {}
    for r in got:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for p in places.values():
        assert [o for o, _ in sorted(p)] == [0, *itertools.accumulate(n for _, n in sorted(p))][:-1] and sum(n for _, n in p) <= 32
    assert len(places) <= -(-sum(r.length for r in got) // 32) + 1


# ---- 8: exact copies


def test_index_is_reopened_with_its_own_buckets(spark):
    at = scratch(spark, "index")
    rows = texts(spark, [(i, f"text {i % 150}") for i in range(200)])
    exact_dedup.mark(rows, exact_dedup.DigestIndex(spark, at, buckets=8), "one").collect()
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        again = exact_dedup.DigestIndex(spark, at, buckets=32)
        assert again.buckets == 8
        exact_dedup.mark(rows, again, "one")
        assert again.rows().count() == 150
        again.close()
        third = exact_dedup.DigestIndex(spark, at)
        got = {r.doc_id: r for r in exact_dedup.mark(texts(spark, [(900, "TEXT 3"), (901, "new"), (902, "text 149")]), third, "two").collect()}
        assert (got[900].keep_id, got[900].group_size, got[900].kept) == (153 if 153 < 200 else 3, 3, False)
        assert (got[901].keep_id, got[901].group_size, got[901].kept) == (901, 1, True) and got[902].group_size == 2
        for _ in range(2):  # a batch that runs again changes nothing
            same = {r.doc_id: r.group_size for r in exact_dedup.mark(texts(spark, [(900, "TEXT 3"), (901, "new"), (902, "text 149")]), third, "two").collect()}
        assert same == {900: 3, 901: 1, 902: 2} and third.rows().count() == 151
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_exact_dedup_with_odd_columns(spark):
    rows = [(1, "a", "p", 1), (2, "A", "q", 2), (3, None, None, None), (4, "", "r", 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _digest string, _NTH int")
    kept = exact_dedup.deduplicate(docs)
    assert kept.columns == docs.columns and {(r.doc_id, r["_digest"], r["_NTH"]) for r in kept.collect()} == {(2, "q", 2), (4, "r", 4)}
    odd = docs.union(spark.createDataFrame([(2, "A", "q", 2), (2, "b", "s", 5), (None, "z", "t", 6), (None, "z", "t", 6)], docs.schema))
    kept = exact_dedup.deduplicate(odd)
    assert kept.columns == docs.columns and sorted((r.doc_id or -1, r.text) for r in kept.collect()) == [(-1, "z"), (2, "A"), (2, "b"), (4, "")]
    assert spark.sql("SHOW TABLES").filter("tableName LIKE 'digest_index_%' AND isTemporary").count() == 0


# ---- 10: chat


def test_chat_of_long_turns_and_clashing_columns(spark):
    long = "[INST] x </s>" * 300_000
    rows = spark.createDataFrame([(1, 1, "assistant", long, "k", 1), (1, 0, "user", "u", "k", 2), (None, 0, "user", "v", None, None)], "conv_id long, turn long, role string, text string, kind string, segment int")
    got = {r.conv_id: r for r in chat.read_back(chat.formatted(rows)).collect()}
    assert got[1].loss_chars == len(long) and got[1].loss_sha256 == hashlib.sha256(long.encode()).hexdigest() and got[1].n_turns == 2
    assert got[None].n_turns == 1


# ---- pipeline


def _pipeline_docs(spark):
    rng = random.Random(2)
    good = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").join(spark.read.parquet(f"{SF}/labels.parquet").filter("quality = 1"), "doc_id").filter("length(text) > 400").orderBy("doc_id").limit(12).collect()]
    rows = [(i, t, "en", "s", len(t), 5) for i, t in enumerate(good)]
    rows += [(100 + i, t.upper() if i % 2 else t, "en", "s", len(t), 5) for i, t in enumerate(good[:4])]
    rows += [(200 + i, t + f" tail{rng.random()}", "en", "s", len(t), 5) for i, t in enumerate(good[4:7])]
    rows += [(300, None, None, None, None, None), (301, "", "en", "s", 0, 1), (302, good[0], "en", "s", 1, 1), (302, good[0], "en", "s", 1, 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, node int")


def test_pipeline_stages_against_brute_force(spark):
    import corpus_pipeline

    stage, docs = dict(corpus_pipeline.STAGES), _pipeline_docs(spark)
    rows = docs.collect()
    model = quality.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    one = stage["quality_classifier"](spark, docs, SF)
    want = [r for r, s in zip(rows, quality.score_texts([r.text or "" for r in rows], model)) if s >= quality.THRESHOLD]
    assert one.columns == docs.columns and Counter(one.collect()) == Counter(want)
    two = stage["exact_dedup"](spark, docs, SF)
    last = {}
    for r in rows:
        key = (r.text or "").translate({c: c + 32 for c in range(65, 91)})
        last[key] = max(last.get(key, r), r, key=lambda x: x.doc_id)
    assert two.columns == docs.columns and Counter(two.collect()) == Counter(last.values())
    three = stage["minhash_near_dedup"](spark, two, SF)
    sets = {r.doc_id: near_dedup.Shingler(5).set_of(r.text) for r in last.values()}
    least = {i: i for i in sets}
    for i, j in itertools.combinations(sorted(sets), 2):
        shared = len(np.intersect1d(sets[i], sets[j]))
        if len(sets[i]) and 100 * shared >= 80 * (len(sets[i]) + len(sets[j]) - shared):
            least = {k: min(least[i], least[j]) if v in (least[i], least[j]) else v for k, v in least.items()}
    assert sorted(r.doc_id for r in three.collect()) == sorted(i for i, k in least.items() if i == k) and three.columns == docs.columns
    four = stage["best_fit_packing"](spark, three, SF).collect()
    assert {r.doc_id for r in four} == {i for i, k in least.items() if i == k}
    for name, f in corpus_pipeline.STAGES:
        assert f(spark, docs.limit(0), SF).count() == 0, name


def test_every_query_of_the_list_is_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 11))
    assert json.dumps(sorted(queries.ORACLE_SQL)) == '["op1_token_counts", "op8_exact_dedup"]'


def test_a_large_component_meets_the_others_alone(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK", 10)
    nodes = range(1, 206)
    component = {n: 1 if n <= 200 else n for n in nodes}
    members = spark.createDataFrame([(7, n, 3, 1) for n in nodes] + [(8, n, 3, 1) for n in range(1, 101)], "key long, node long, n_shingles long, leader long")
    found = spark.createDataFrame([(n, 1) for n in range(1, 201)], "id long, least long")
    groups = {}
    for r in near_dedup.in_groups(near_dedup.unresolved(members, found)).collect():
        assert r.key == 7 and r.component == component[r.node] and r.own in (r.i, r.j)
        groups.setdefault((r.i, r.j), []).append((r.node, r.own))
    assert sum(map(len, groups.values())) <= 199 + 5 * 21  # the large component once, the others once for each of its blocks and for their own
    met = [(min(a, b), max(a, b)) for (i, j), of in groups.items() for a, x in of for b, y in of if x == i and y == j and component[a] != component[b] and (i != j or a < b)]
    assert sorted(met) == [(a, b) for a in range(2, 206) for b in range(max(a + 1, 201), 206)]
