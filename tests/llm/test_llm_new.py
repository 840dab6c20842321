"""Language ID, collocations and the Merkle manifest against brute force and held-out labels."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.llm import collocations, langid, merkle

DOC = "doc_id long, source string, lang string, n_chars long, text string"
ODD = [(1, "s", "en", 3, "Ab C"), (2, None, None, None, None), (3, "s", None, 0, ""), (4, "", "en", 9, "ÄB\n"), (4, "", "en", 9, "ÄB\n"), (4, "t", "en", 9, "x"), (None, "s", "en", 1, "Q"), (None, None, "de", 1, "Q"), (2**60, "s", "", 1, "Z" * 100_000)]


# ---- Merkle manifest


def _h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def _leaf(row, text):
    return _h(*("-" if x is None else f"{len(str(x).encode())}:{x}" for x in (*row[:4], text)))


def _tree(nodes):
    """The top of a tree over `nodes`, and each one's path as (left, right)."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for k, i in enumerate(at):
            run = nodes[i // 8 * 8 : i // 8 * 8 + 8]
            paths[k].append(("".join(run[: i % 8]), "".join(run[i % 8 + 1 :])))
            at[k] = i // 8
        nodes = [_h(*nodes[i : i + 8]) for i in range(0, len(nodes), 8)]
    return nodes[0], paths


def _manifest(rows):
    """What the query returns, by hand."""
    by_lang = {}
    for r in rows:
        by_lang.setdefault(r[2], []).append(r)
    langs = sorted(by_lang, key=lambda x: (x is not None, (x or "").encode()))
    tops = []
    for x in langs:
        by_lang[x].sort(key=lambda r: (r[0] is not None, r[0] or 0, _leaf(r, r[4])))
        tops.append(_tree([_leaf(r, r[4]) for r in by_lang[x]]))
    root, above = _tree([t for t, _ in tops])
    out = []
    for x, (top, paths), up in zip(langs, tops, above):
        for r, path in zip(by_lang[x], paths):
            now = r[4]
            if now is not None and r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0:
                now = re.sub("[A-Z]", lambda m: m[0].lower(), now)
            node = _leaf(r, now)
            for a, b in path + up:
                node = _h(a, node, b)
            out.append((r[0], _leaf(r, r[4]), top, root, _h("".join(a + b for a, b in path + up)), node, node == root))
    return sorted(out, key=str)


def _proofs(spark, rows, **how):
    leaves = merkle.leaves_of(spark.createDataFrame(rows, DOC).withColumn("_at", F.lit(1)).withColumn("leaf", F.lit("x")), merkle.tampered_text())
    return merkle.build(leaves, **how)


NAMES = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def _many(n, langs="en en en en de fr".split()):
    rng = random.Random(n)
    return [(i, f"s{i % 7}", rng.choice(langs), i % 90, "".join(rng.choice("aBc \n") for _ in range(i % 50))) for i in rng.sample(range(10 * n), n)]


@pytest.mark.parametrize("rows, how", [(ODD, {}), (_many(9, ["en"]), {}), (_many(1), {}), (_many(1200), {}), (_many(700), {"height": 1, "top": 4}), (_many(700) + ODD, {"height": 2, "top": 1})], ids=["odd", "nine", "one", "blocks", "four rounds", "two rounds"])
def test_manifest_equals_a_plain_tree(spark, rows, how):
    m = _proofs(spark, rows, **how)
    got = merkle.proofs(m, with_path=True)
    assert sorted((tuple(r) for r in got.select(*NAMES).collect()), key=str) == _manifest(rows)
    for r in got.limit(20).collect():
        path = merkle.unpacked(bytes(r["path"]))
        assert merkle.fold(r["leaf"], path) == r["root"] == m.root and merkle.proof_sha256(path) == r["proof_sha256"]
    assert {r["subroot"] for r in m.subroot_rows().collect()} == {r["subroot"] for r in got.collect()} and sum(r["n_leaves"] for r in m.subroot_rows().collect()) == len(rows)


def test_manifest_of_nothing(spark):
    m = _proofs(spark, [])
    assert m.root is None and merkle.proofs(m).count() == 0 and m.subroot_rows().count() == 0


# ---- collocations

WORDS = "Of the new york stock exchange a in to and rio de janeiro x".split()


def _texts(seed, n):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        words = [rng.choice(WORDS) for _ in range(rng.randrange(40))]
        if i % 2:
            words += "new york stock exchange".split()
        out.append((i, rng.choice([None, "en", "en", "und", "de"]), "".join(w + rng.choice([" ", "  ", "\t", ". ", ",", "\n", "\x0b", " ", " "]) for w in words)))
    return out + [(n, "en", None), (n + 1, None, ""), (n + 2, "de", " ..\t;\n"), (n + 3, "en", "new york " * 500), (n + 3, "en", "new york " * 500)]


def _top(rows, least, longest, share, keep):
    f, total = Counter(), Counter()
    for _, lang, text in rows:
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = [x for x in re.split(r"[\x20\x09]+", piece) if x]
            total[lang or "und"] += len(w)
            f.update((lang or "und", tuple(w[i : i + m])) for m in range(1, longest + 1) for i in range(len(w) - m + 1))
    cand = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    out = {}
    for (lang, p), a in cand.items():
        if any(x == lang and len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) and 100 * b >= share * a for (x, q), b in cand.items()):
            continue
        cuts = [(2000000 * a // (f[lang, p[:k]] + f[lang, p[k:]]), k) for k in range(1, len(p))]
        score, k = min(cuts)
        out.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
    return sorted((lang, i, p.decode(), -a, left, right, total[lang], -s) for lang, v in out.items() for i, (s, a, p, left, right) in enumerate(sorted(v)[:keep], 1))


@pytest.mark.parametrize("least, longest, keep, bits", [(30, 4, 2000, 20), (5, 4, 7, 17), (300, 3, 50, 16), (2, 2, 2000, 18)])
def test_collocations_equal_plain_counts(spark, least, longest, keep, bits):
    rows = _texts(least, 300)
    docs = spark.createDataFrame([(i, x, t, "n") for i, x, t in rows], "doc_id long, lang string, text string, phrase string")
    got = collocations.top(docs, least, longest, keep=keep, bits=bits)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(tuple(r) for r in got.collect()) == _top(rows, least, longest, collocations.SHARE, keep)


def test_collocations_of_nothing(spark):
    for rows in ([], [(1, "en", "a b c")], [(1, None, None)]):
        assert collocations.top(spark.createDataFrame(rows, "doc_id long, lang string, text string"), bits=16).count() == 0


def test_full_vocabularies_and_buckets_lose_nothing(spark, monkeypatch):
    rows = _texts(8, 200)
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    parts = collocations.counted(docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text")), 1, 5, 4, 16, {})
    whole = collocations.bitmap(parts.filter("slice IS NOT NULL"), 5, 16)
    assert len(whole) == 8192 and 0 < np.unpackbits(np.frombuffer(whole, np.uint8)).sum() < 400
    # one bit for all buckets: no test prunes, and counts stay the same
    assert sorted(tuple(r) for r in collocations.top(docs, 5, bits=3).collect()) == _top(rows, 5, 4, collocations.SHARE, collocations.KEEP)


def test_counts_past_64_bits_stay_exact(spark):
    a = 4 * 10**18
    grams = spark.createDataFrame([("en", "a", 1, 9 * 10**18), ("en", "b", 1, a + 1), ("en", "a b", 2, a)], "lang string, phrase string, words int, a long")
    assert [tuple(r) for r in collocations.candidates(grams).collect()] == [("en", "a b", a, 9 * 10**18, a + 1, 2000000 * a // (13 * 10**18 + 1))]


# ---- language ID


def test_codes_keep_their_distance():
    for n in (2, 3, 4, 6, 7, 20, 60):
        code = langid.codes_for(n).astype(int)
        apart = [(code[i] != code[j]).sum() for i in range(n) for j in range(i)]
        assert min(apart) >= max(1, code.shape[1] // (2 if n < 7 else 5)) and (np.abs(code.sum(0)) < n).all()
    assert langid.codes_for(1).shape == (1, 0)


SPEECH = {
    "en": "the house and the garden were quiet when she opened that old door with both hands",
    "de": "das haus und der garten waren still als sie die alte schwere tür mit beiden händen öffnete",
    "fr": "la maison et le jardin étaient calmes quand elle ouvrit cette vieille porte des deux mains",
    "es": "la casa y el jardín estaban tranquilos cuando ella abrió aquella vieja puerta con las manos",
    "ru": "дом и сад были тихими когда она открыла эту старую дверь двумя руками",
    "ja": "彼女がその古い扉を両手で開けたとき家と庭は静かだった",
    "pl": "dom i ogród były ciche kiedy otworzyła te stare drzwi obiema rękami",
}


def _speech(n, langs):
    rng = random.Random(5)
    return [(i, x, " ".join(rng.choices(SPEECH[x].split(), k=rng.randrange(3, 60))) if x != "ja" else "".join(rng.choices(SPEECH[x], k=40))) for i, x in enumerate(rng.choices(langs, k=n))]


@pytest.mark.parametrize("langs", [["en", "de"], ["en", "de", "fr", "es"], list(SPEECH)])
def test_languages_are_told_apart(spark, langs):
    docs = spark.createDataFrame(_speech(600, langs), "doc_id long, lang string, text string").withColumn("score", F.lit("x"))
    model = langid.fit(docs.filter("doc_id % 4 <> 2"))
    got = langid.predict(docs.filter("doc_id % 4 = 2"), model).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in got) >= 0.98 * len(got) and all(0 <= r["score"] <= 1 for r in got)
    mixed = langid.predict(spark.createDataFrame([(1, SPEECH["en"] + " " + SPEECH["de"]), (2, "zz")], "doc_id long, text string"), model).collect()
    clear = [r["score"] for r in got if r["lang"] == "de" and r["lang"] == r["lang_pred"]]
    assert all(r["score"] <= max(clear) for r in mixed)


def test_languages_of_odd_texts(spark):
    docs = spark.createDataFrame(_speech(80, ["en", "de"]) + [(900, None, "wer da"), (901, "en", None), (None, "de", "wer ist da"), (902, "xx", "")], "doc_id long, lang string, text string")
    model = langid.fit(docs)
    asked = spark.createDataFrame([(1, None), (2, ""), (3, "123 ²½ _!"), (4, "der die das und " * 20_000), (4, "der die das und"), (None, "the and with")], "doc_id long, text string")
    got = sorted(((r["doc_id"] or 0, r["lang_pred"]) for r in langid.predict(asked, model).collect()))
    assert got == [(0, "en"), (1, "und"), (2, "und"), (3, "und"), (4, "de"), (4, "de")]
    one = langid.fit(docs.filter("lang = 'en'"))
    assert [(r["lang_pred"], r["score"]) for r in langid.predict(asked.filter("doc_id = 4"), one).collect()] == [("en", 1.0)] * 2
    none = langid.fit(docs.limit(0))
    assert {(r["lang_pred"], r["score"], r["ambiguous"]) for r in langid.predict(asked, none).collect()} == {("und", 0.0, True)}
    assert langid.predict(asked.limit(0), model).count() == 0


def test_a_sample_is_bounded_whatever_repeats(spark):
    docs = spark.createDataFrame([(7, "en", "same text")], "doc_id long, lang string, text string").crossJoin(spark.range(500).select()).unionByName(spark.createDataFrame(_speech(300, ["de"]), "doc_id long, lang string, text string"))
    chosen, langs = langid._sample(docs, 50)
    assert langs == ["de", "en"] and {r["lang"]: r["count"] for r in chosen.groupBy("lang").count().collect()} == {"de": 48, "en": 3}  # 16 groups; equal rows are in one
