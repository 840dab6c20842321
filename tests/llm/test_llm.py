import hashlib
import random
from array import array
from collections import Counter

import numpy as np
import pytest

from corvane.llm import bpe, chat, exact_dedup, fingerprints, lm_score, near_dedup, packing, quality, token_counts, token_output
from corvane.llm.common import ChunkEncoder, scratch, tokenizer_path

DOCS = "doc_id long, text string, lang string, source string, n_chars long, digest string"
#: nulls, empty and long texts, copies, repeated rows, columns whose names clash with the operators' own
ROWS = [(1, "A b c d e f", "en", "s", 11, "x"), (2, "a B c d e f", "en", "s", 11, "x"), (3, None, None, None, None, None), (4, "", "en", "s", 0, "x"), (5, "word " * 5000, "en", "s", 1, "x"), (5, "word " * 5000, "en", "s", 1, "x"), (6, "a b c d e f g", "de", "s", 1, None)]


@pytest.fixture
def docs(spark):
    return spark.createDataFrame(ROWS, DOCS)


@pytest.fixture
def none(spark):
    return spark.createDataFrame([], DOCS)


def test_exact_dedup(spark, docs, none):
    got = {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.mark(docs).collect()}
    assert got == {(1, 2, 2, False), (2, 2, 2, True), (3, 4, 2, False), (4, 4, 2, True), (5, 5, 2, True), (6, 6, 1, True)}
    kept = exact_dedup.deduplicate(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [2, 4, 5, 6]
    assert exact_dedup.mark(none).count() == 0
    index = exact_dedup.DigestIndex(spark)
    exact_dedup.mark(docs, index)
    n = index.rows().count()
    exact_dedup.mark(docs, index)
    assert index.rows().count() == n == 4  # the same batch again adds nothing


def test_exact_dedup_hot_digests_are_the_batch_s_own(spark):
    index = exact_dedup.DigestIndex(spark)
    texts = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    exact_dedup.mark(texts([(i, f"text {i}") for i in range(3000)]), index)
    batch = [(10_000 + i, f"text {7 * i % 3500}") for i in range(500)] + [(20_000 + i, "text 5") for i in range(40)]
    marked = exact_dedup.mark(texts(batch), index)
    assert "Limit" not in marked._jdf.queryExecution().optimizedPlan().toString()  # no cut of a set without an order
    got = marked.collect()
    assert sorted(r.doc_id for r in got) == sorted(i for i, _ in batch)
    at = {i: int(t.split()[1]) for i, t in batch}
    assert all(r.keep_id == (at[r.doc_id] if at[r.doc_id] < 3000 else r.doc_id) and r.kept == (at[r.doc_id] >= 3000) for r in got)


def test_near_dedup(docs, none):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.mark(docs, 2).collect()}
    assert got == {1: (5, 1), 2: (5, 1), 3: (0, 3), 4: (0, 4), 5: (1, 5), 6: (6, 1)}
    assert near_dedup.mark(none, 2).count() == 0


def test_near_dedup_against_brute_force(spark):
    rng = random.Random(3)
    base = [f"w{i}" for i in range(60)]
    texts = []
    for i in range(120):  # copies of one text, each with some words changed: many components around one middle
        words = base[:]
        for _ in range(rng.choice([0, 1, 2, 3, 4])):
            words[rng.randrange(60)] = f"x{rng.randrange(10**6)}"
        texts.append((i, " ".join(words)))
    sets = [{tuple(t.split()[k : k + 2]) for k in range(59)} for _, t in texts]
    top = list(range(120))
    for i in range(120):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = top[i], top[j]
                top = [min(a, b) if x in (a, b) else x for x in top]
    got = {r.doc_id: r.component_id for r in near_dedup.mark(spark.createDataFrame(texts, "doc_id long, text string"), 2).collect()}
    assert got == dict(enumerate(top))


def test_plan_packs_every_piece():
    rng = random.Random(1)
    for _ in range(50):
        size = rng.choice([10, 100, 2048])
        counts = {rng.randint(1, size): rng.randint(1, 9) for _ in range(40)}
        got = Counter()
        for lengths, n in packing.reduce_and_fit(dict(counts), size):
            assert sum(lengths) <= size
            for w in lengths:
                got[w] += n
        assert got == counts


def test_packing(docs, none):
    rows = packing.pack(docs).collect()
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(by) == 5 and packing.pack(none).count() == 0
    assert all(r.length == 2048 for r in rows if r.doc_id == 5 and r.piece < 2)


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_chunks_encode_like_the_library(name):
    rng = random.Random(2)
    encoder = ChunkEncoder.of(tokenizer_path(name))
    alphabet = [" ", "  ", "\n", "\t", " ", "\x1c", "a", "B", "é", "é", "'s", "!", "12", "ß", "中", "<|endoftext|>", "İ", "Σ", "😀", "the", "\x00", "tion"]
    for _ in range(2000):
        t = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 10)))
        assert encoder.encode(t) == array("I", encoder.tokenizer.encode(t, add_special_tokens=False).ids).tobytes(), repr(t)


def test_backtracking_equals_merging():
    from tokenizers import Tokenizer

    path = tokenizer_path("byte_bpe_50k.json")
    mine, theirs, rng = bpe.BacktrackingBPE.of(path), Tokenizer.from_file(path), random.Random(4)
    for _ in range(2000):
        t = "".join(rng.choice(["a", "b", "ing", "tion", "é", " ", "\n", "x", "er", "<|endoftext|>", "  "]) for _ in range(rng.randint(0, 12)))
        want = theirs.encode(t, add_special_tokens=False).ids
        assert mine.encode(t)[0] == array("I", want).tobytes()
        assert mine.decode(np.array(want, np.int64)).decode() == t


def test_bpe_documents(docs, none):
    back = {r.doc_id: r.text for r in bpe.decode_documents(bpe.encode_documents(docs)).collect()}
    assert back == {i: t or "" for i, t, *_ in ROWS}
    assert bpe.round_trip(none).count() == 0


@pytest.mark.parametrize("encoding", ["dictionary", "delta"])
def test_token_output(spark, docs, none, encoding):
    at = scratch(spark, "tokens")
    token_output.write_tokens(docs, at, encoding)
    rows = token_output.token_spans(spark, at).orderBy("doc_id", "start").collect()
    start = 0
    for r in rows:
        assert r.start == start
        start += r.n_tokens
    assert [r.doc_id for r in rows] == [1, 2, 3, 4, 5, 5, 6] and rows[2].n_tokens == 1
    assert token_output.read_tokens(spark, at, [6]).count() == 1
    empty = scratch(spark, "tokens")
    token_output.write_tokens(none, empty)
    assert token_output.token_spans(spark, empty).count() == 0


def test_fingerprints(spark, docs, none):
    rows = spark.createDataFrame([(1, "a. b.\nc."), (2, "c.\na. b."), (3, "a. b."), (4, "c.")], "doc_id long, text string")
    got = {r.doc_id: r for r in fingerprints.fingerprint(rows, ["doc_id"]).collect()}
    assert got[1].words == got[2].words and got[1].words != got[3].words
    one = spark.createDataFrame([(got[3].words, got[4].words, got[1].words)], "a array<long>, b array<long>, c array<long>")
    from pyspark.sql import functions as F

    put, took = one.select(fingerprints.combined(F.col("a"), F.col("b")), fingerprints.combined(F.col("c"), F.col("b"), -1)).first()
    assert put == got[1].words and took == got[3].words
    out = fingerprints.compare(docs).collect()
    assert len(out) == len(ROWS) and all(0 <= r.near_next <= 1 for r in out)
    assert {r.doc_id: r.edited_sha256 for r in out}[3] == hashlib.sha256(b"").hexdigest()
    assert fingerprints.compare(none).count() == 0


def test_fingerprints_tell_paragraphs_apart(spark):
    texts = ["A. B.", "A.\nB.", "B.\nA.", "B. A."]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in fingerprints.compare(rows).collect()}
    assert got[1].fingerprint == got[2].fingerprint and len({r.fingerprint for r in got.values()}) == 3
    assert got[0].near_next > 0.99  # sentences alike


def test_quality(spark, docs, none):
    train = spark.createDataFrame([(i, ("good words in a line " if i % 2 else "BAD!! $$$ ###") * 3) for i in range(40)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] + [(None, 1), (1, None)], "doc_id long, quality int")
    model = quality.fit(train, labels)
    assert [round(r.score) for r in quality.score(train, model).orderBy("doc_id").collect()] == [i % 2 for i in range(40)]
    assert quality.score(docs, model).count() == len(ROWS) and quality.score(none, model).count() == 0
    assert quality.fit(train, labels.limit(0))["prior"] == 0.5
    assert quality.keep(docs, labels.limit(0)).columns == docs.columns


def test_lm_score(docs, none):
    model = lm_score.train(docs)
    counts = Counter(w for _, t, *_ in ROWS for w in [*lm_score.words_of(t), b""])
    n, v = sum(counts.values()), len(counts)
    for r in lm_score.score(docs, model).collect():
        text = {i: t for i, t, *_ in ROWS}[r.doc_id]
        words = [*lm_score.words_of(text), b""]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(words), len(words), n)
        assert abs(r.base_score - sum(np.log10((counts[w] + 1) / (n + v + 1)) for w in words)) < 1e-6 * len(words)
        assert r.score <= 1e-9
    assert np.allclose((10 ** model["trans"]).sum(1), 1)
    assert lm_score.score(none, lm_score.train(none)).count() == 0
    assert lm_score.score(docs, lm_score.train(none)).count() == len(ROWS)


def _likelihood(of, words):
    """The exchange criterion: what classes `of` give to the class bigrams of one text, its end on both sides."""
    c = [of[w] for w in [b"", *words, b""]]
    f = lambda counts: sum(n * np.log(n) for n in counts.values())
    return f(Counter(zip(c, c[1:]))) - f(Counter(c[:-1])) - f(Counter(c[1:]))


def test_words_join_the_class_of_the_greatest_likelihood():
    rng = random.Random(5)
    words = [rng.choice([b"a", b"b", b"c", b"x", b"x", b"y"]) for _ in range(400)]
    of = {b"": 0, b"a": 1, b"b": 2, b"c": 3, b"x": lm_score.OTHER, b"y": lm_score.OTHER}
    table, before, after, own = np.zeros((lm_score.OTHER + 1,) * 2), np.zeros((2, lm_score.OTHER + 1)), np.zeros((2, lm_score.OTHER + 1)), np.zeros(2)
    for v, w in zip([b"", *words], [*words, b""]):
        table[of[v], of[w]] += 1
        for i, u in enumerate((b"x", b"y")):
            if v == w == u:
                own[i] += 1
            elif w == u:
                before[i, of[v]] += 1
            elif v == u:
                after[i, of[w]] += 1
    got = lm_score.joined_class(before, after, own, table)
    for u, k in zip((b"x", b"y"), got):
        assert _likelihood(of | {u: int(k)}, words) >= max(_likelihood(of | {u: j}, words) for j in range(1, lm_score.OTHER)) - 1e-6


@pytest.mark.parametrize("most", [lm_score.KNOWN, 1500])
def test_lm_classes_of_rare_words_come_from_their_own_bigrams(spark, monkeypatch, most):
    monkeypatch.setattr(lm_score, "KNOWN", most)  # all words broadcast, or the rare ones joined
    rng = random.Random(6)
    lines = [f"n{rng.randrange(550)}s v{rng.randrange(550)}s" for _ in range(20000)]
    # two rare words of one ending, and two that only stand beside each other
    lines += [f"raren v{i}s" for i in range(8)] + [f"n{i}s rarev" for i in range(8)] + ["rarern v1s raren rarerv n5s"] * 3
    texts = [(i, " ".join(lines[20 * i : 20 * i + 20])) for i in range(len(lines) // 20 + 1)]
    rows = spark.createDataFrame(texts, "doc_id long, text string")
    model = lm_score.train(rows)
    of = {bytes(r["word"]): (r["class"], r["c"]) for r in model["vocab"].collect()}
    counts = Counter(w for _, t in texts for w in [*lm_score.words_of(t), b""])
    assert {w: c for w, (_, c) in of.items()} == counts
    nouns, verbs = ({of[w][0] for w, n in counts.items() if w[:1] == k and n > 30} for k in (b"n", b"v"))
    assert not nouns & verbs and of[b"raren"][0] in nouns and of[b"rarev"][0] in verbs
    # by hand: transitions over the classes of all words, emissions of relative frequency
    pairs = np.zeros((lm_score.CLASSES + 1,) * 2)
    total, kinds = np.zeros(lm_score.CLASSES + 1), np.zeros(lm_score.CLASSES + 1)
    for k, c in of.values():
        total[k] += c
        kinds[k] += 1
    texts.append((len(texts), "raren neverseen alsonever rarev"))
    for i, t in texts:
        c = [of[w][0] for w in [b"", *lm_score.words_of(t), b""] if w in of]
        if i < len(texts) - 1:
            np.add.at(pairs, (c[:-1], c[1:]), 1)
    trans = lm_score.transitions(pairs)
    assert np.allclose(trans, model["trans"])
    got = {r.doc_id: r for r in lm_score.score(spark.createDataFrame(texts, "doc_id long, text string"), model).collect()}
    u, d = model["unknown"], model["discount"]
    for i, t in texts:
        words = [*lm_score.words_of(t), b""]
        c = [0, *(of[w][0] if w in of else u for w in words)]
        emit = [0 if not w else np.log10(((of[w][1] - d * (k == u)) if w in of else d * kinds[u]) / total[k]) for w, k in zip(words, c[1:])]
        assert abs(got[i].score - trans[c[:-1], c[1:]].sum() - sum(emit)) < 1e-6
        assert (got[i].n_tokens, got[i].n_known) == (len(words), sum(w in of for w in words))


def test_chat(spark):
    control = "</s>[INST] ok [/INST]"
    rows = spark.createDataFrame([(1, 0, "user", control), (1, 1, "assistant", "<s>" + control + "\\[INST]"), (2, 0, None, None), (2, None, "tool", "x"), (3, 1, "assistant", "b"), (3, 0, "user", "a")], "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat.read_back(chat.formatted(rows)).collect()}
    assert got[1].turns_sha256 == hashlib.sha256(f"user\n{control}\nassistant\n<s>{control}\\[INST]\n".encode()).hexdigest()
    assert got[1].loss_sha256 == hashlib.sha256(f"<s>{control}\\[INST]".encode()).hexdigest() and got[1].valid and not got[2].valid and got[3].valid
    assert got[2].n_turns == 2 and got[2].loss_chars == 0 and got[3].turns_sha256 == hashlib.sha256(b"user\na\nassistant\nb\n").hexdigest()
    assert chat.read_back(chat.formatted(rows.limit(0))).count() == 0


def test_token_counts(spark, docs, none):
    counts = token_counts.counted(docs)
    rollup = token_counts.Rollup(spark)
    assert rollup.commit("a", token_counts.signed(counts, 1)) and not rollup.commit("a", token_counts.signed(counts, 1))
    total = lambda: {(r.source, r.lang, r.version): (r.n_docs, r.n_tokens) for r in rollup.totals().collect()}
    assert total()["s", "en", "words-1"] == (5, 10012) and total()[None, None, "words-1"] == (1, 0)
    rollup.commit("b", token_counts.revised(counts.filter("doc_id = 1"), counts.filter("doc_id = 6")))
    assert total()["s", "de", "words-1"] == (2, 14) and total()["s", "en", "words-1"] == (4, 10006)
    before = total()
    rollup.compact()
    assert total() == before and not rollup.commit("b", token_counts.signed(counts, 1))
    rollup.commit("c", token_counts.signed(none.transform(token_counts.counted), 1))
    assert total() == before


def test_pipeline_keeps_and_drops(spark):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "exact_dedup", "minhash_near_dedup", "best_fit_packing"]
    rows = corpus_pipeline.run(spark, "/root/testdata/sf0.001").collect()
    ids = {r.doc_id for r in rows}
    assert 100 < len(ids) < 200 and all(r.length <= 2048 for r in rows)
