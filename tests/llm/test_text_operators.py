"""Each operator against brute force on small tables, with nulls, empty and long texts, repeated rows and clashing names."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from genoloom.llm import common, decontam, icws, langid, lm, mixing, quality, quotes, rules, substring, tokcount
from genoloom.llm.fmindex import FMIndex, WaveletMatrix
from genoloom.llm.gru import Gru

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, n_words string, score string"
RNG = np.random.default_rng(4)
VOCABULARY = ["".join(RNG.choice(list("abcdeéü"), RNG.integers(1, 7))) for _ in range(400)]


def prose(n: int) -> str:
    return " ".join(RNG.choice(VOCABULARY, n))


def words(text: str | None) -> list[str]:
    return [w for w in re.split("[\x20\x09-\x0d]+", text or "") if w]


PASSAGE, BASE = prose(60), prose(200)
NEAR = " ".join(w if i not in (50, 120) else "changed" for i, w in enumerate(BASE.split()))
TEXTS = [
    (1, BASE), (2, NEAR), (3, BASE), (4, prose(50) + " " + PASSAGE + " " + prose(40)), (5, PASSAGE + "\n" + prose(80)), (6, None), (7, ""), (8, " \t\n"), (None, prose(30)),
    (9, "one two"), (9, "one two"), (10, "re " * 100), (11, prose(20000)), (12, "x" * 50000), (13, "Ümlaut\x0bword\n\nline\nline\n"), (14, prose(34)), (15, prose(35)), (None, None), (16, "a  b "),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, ["en", "de", None][k % 3], [None, "a", "b"][k % 3], 0, "x", "y") for k, (i, t) in enumerate(TEXTS)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def keyed(df, *columns):
    return Counter(tuple(r) for r in df.select("doc_id", *columns).collect())


def test_words_agree_with_python():
    arr = pa.array([t for _, t in TEXTS], pa.string())
    got = []
    for _, _, data, bounds in common.chunks(arr, 1000):
        w = common.Words(data, bounds)
        got += [[w.text(k).decode() for k in range(a, b)] for a, b in zip(w.first[:-1], w.first[1:], strict=True)]
    assert got == [words(t) for _, t in TEXTS]


def test_hash_table():
    keys = RNG.integers(0, 1 << 63, 5000, dtype=np.uint64)
    table = common.HashTable(keys, np.arange(5000), -1)
    assert (table(keys) == np.arange(5000)).all() and (table(keys + np.uint64(1)) == -1).all()


# substring dedup


def removed(texts: list[str | None], n: int) -> list[list[bool]]:
    seen = Counter(tuple(w[i : i + n]) for w in map(words, texts) for i in range(len(w) - n + 1))
    out = []
    for w in map(words, texts):
        gone = [False] * len(w)
        for i in range(len(w) - n + 1):
            if seen[tuple(w[i : i + n])] > 1:
                gone[i : i + n] = [True] * n
        out.append(gone)
    return out


@pytest.mark.parametrize("hot", [1000, 1])
def test_substring_dedup(docs, hot):
    expected = Counter()
    for (i, t), gone in zip(TEXTS, removed([t for _, t in TEXTS], 35), strict=True):
        kept = " ".join(w for w, g in zip(words(t), gone, strict=True) if not g)
        expected[(i, len(gone), sum(gone), hashlib.sha256(kept.encode()).hexdigest())] += 1
    assert keyed(substring.substring_dedup(docs, hot=hot, shard_words=500), "n_words", "n_removed", "kept_sha256") == expected


def test_substring_dedup_of_nothing(none):
    assert substring.substring_dedup(none).isEmpty() and substring.cut_repeats(none).isEmpty()


def test_cut_repeats_keeps_columns_and_words(docs):
    got = Counter((r["doc_id"], tuple(words(r["text"])), r["n_words"]) for r in substring.cut_repeats(docs).collect())
    expected = Counter()
    for (i, t), gone in zip(TEXTS, removed([t for _, t in TEXTS], 35), strict=True):
        if kept := tuple(w for w, g in zip(words(t), gone, strict=True) if not g):
            expected[(i, kept, "x")] += 1
    assert got == expected


def test_fm_index_counts():
    text = RNG.integers(0, 5, 400).astype(np.uint64)
    bounds = np.array([0, 150, 151, 400])
    index = FMIndex(text, bounds, np.array([1, 1, 3]), 12)
    pieces = [text[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]

    def mass(p):
        return sum(m * sum(x[i : i + len(p)] == p for i in range(len(x) - len(p) + 1)) for x, m in zip(pieces, (1, 1, 3), strict=True))

    ends = np.arange(300, 340)
    got = index.repeated_from(ends, np.full(len(ends), 12), least=4)
    for e, n in zip(ends, got, strict=True):
        longest = max([k for k in range(1, 13) if mass(text[e - k : e].tolist()) >= 4], default=0)
        assert n == longest


# near duplicates


def test_near_duplicates(docs):
    got = {}
    for r in icws.near_duplicates(docs).collect():
        got.setdefault(r["doc_id"], set()).add(r["class_id"])
    assert got[1] == got[2] == got[3] == {1} and got[9] == {9} and got[6] == got[7] == {6}
    assert all(got[i] == {i} for i in (4, 5, 8, 10, 11, 12, 13, 14, 15, 16))


def test_unique(docs, none):
    ids = Counter(r["doc_id"] for r in icws.unique(docs).collect())
    assert ids[1] == 1 and ids[2] == ids[3] == 0 and ids[9] == 1 and ids[11] == 1
    assert icws.unique(none).isEmpty() and icws.near_duplicates(none).isEmpty()


def test_large_buckets_lose_no_link(spark, monkeypatch):
    """A bucket of 60 texts round one passage, 12 twins among them that share no other bucket, and hubs that are similar to none."""
    shared = prose(20)
    own = [prose(60) for _ in range(48)]
    texts = [f"{shared} {x}" for x in own] + [f"{shared} {own[i]} twin" for i in range(36, 48)]
    one = lambda s, n_docs, bands, rows: (np.arange(n_docs), np.column_stack([np.zeros(n_docs), *(RNG.integers(1, 1 << 62, n_docs) for _ in range(bands - 1))]).astype(np.uint64))
    monkeypatch.setattr(icws, "signatures", one)
    df = spark.createDataFrame([(i, t, None, None, 0, "x", "") for i, t in enumerate(texts)], SCHEMA).coalesce(1)
    got = {r["doc_id"]: r["class_id"] for r in icws.near_duplicates(df).collect()}
    assert got == {i: i if i < 48 else i - 12 for i in range(60)}


def brute_classes(texts: list[str]) -> list[int]:
    """The least index of each text's class, over all pairs: plain sets of (five words, how often so far), weighted by the sum of the words' IDF."""
    rows = [words(re.sub("[A-Z]", lambda m: m[0].lower(), x)) for x in texts]
    df = Counter(w for r in rows for w in set(r))
    idf = {w: round(float(np.float32(np.log1p(len(rows) / n))) * 1024) for w, n in df.items()}
    sets = []
    for r in rows:
        grams, seen, own = [tuple(r[i : i + 5]) for i in range(len(r) - 4)] or ([tuple(r)] if r else []), Counter(), {}
        for g in grams:
            own[(g, seen[g])] = sum(idf[w] for w in g)
            seen[g] += 1
        sets.append(own)
    parent = list(range(len(texts)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            both = sum(v for k, v in a.items() if k in sets[j])
            if texts[i] == texts[j] or (both and both / (sum(a.values()) + sum(sets[j].values()) - both) >= 0.8):
                x, y = root(i), root(j)
                parent[max(x, y)] = min(x, y)
    return [root(i) for i in range(len(texts))]


def edited(base: list[str], n: int) -> str:
    return " ".join(w if i not in set(RNG.choice(len(base), n, replace=False).tolist()) else f"e{RNG.integers(10**9)}" for i, w in enumerate(base))


@pytest.mark.parametrize("tile", [icws.TILE, 7])
def test_near_duplicates_are_those_of_all_pairs(spark, monkeypatch, tile):
    """Families of 60 near copies round a base that is there or not, texts round one passage, chains, ties and short texts."""
    monkeypatch.setattr(icws, "TILE", tile)
    texts: list[str] = []
    for k, edits in enumerate((2, 4, 6)):
        base = prose(220).split()
        texts += ([" ".join(base)] if k % 2 else []) + [edited(base, int(RNG.integers(1, edits + 1))) for _ in range(60)]
    passage = prose(120)
    texts += [f"{passage} {prose(30)}" for _ in range(60)]
    chain = prose(200).split()
    for _ in range(8):
        chain = edited(chain, 3).split()
        texts.append(" ".join(chain))
    texts += ["one two", "One TWO", "one", "a b c d", prose(5), "re " * 90, "re " * 100, texts[0], re.sub("[a-z]", lambda m: m[0].upper(), texts[0])]
    df = spark.createDataFrame([(i, t, None, None, 0, "x", "") for i, t in enumerate(texts)], SCHEMA).repartition(3)
    got = {r["doc_id"]: r["class_id"] for r in icws.near_duplicates(df).collect()}
    want = brute_classes(texts)
    assert [got[i] for i in range(len(texts))] == want and len(set(want)) > 70


def test_consistent_samples_estimate_similarity():
    idf = common.HashTable(np.zeros(0, np.uint64), np.zeros(0), 1.0)
    a, b = prose(400), None
    b = " ".join(w if i % 40 else "other" for i, w in enumerate(a.split()))
    data = np.frombuffer((a + b).encode(), np.uint8)
    bounds = np.array([0, len(a.encode()), len(data)])
    s = icws.Shingles(common.Words(data, bounds, lower=True), idf)
    _, sig = icws.signatures(s, 2, 600, 1)
    pair = [tuple(x[np.argsort(s.hash[s.doc == d])] for x in (s.hash[s.doc == d], s.weight[s.doc == d])) for d in (0, 1)]
    assert (sig[0] == sig[1]).mean() == pytest.approx(icws.similarity(*pair), abs=0.06)


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 30)] + [(50, 51), (51, 52), (50, 60)]
    got = dict((r[0], r[1]) for r in icws.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect())
    assert {got[i] for i in range(1, 31)} == {1} and {got[i] for i in (50, 51, 52, 60)} == {50}


# decontamination


def test_decontamination(spark, docs, none):
    item = PASSAGE.split()
    near = " ".join(w if i != 30 else "edited" for i, w in enumerate(item))
    far = " ".join(w if i % 4 else "edited" for i, w in enumerate(item))
    bench = spark.createDataFrame([("p", PASSAGE.upper()), ("far", far), ("short", "one, two!"), ("null", None), ("empty", " ")], "item_id string, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontam.contaminated(docs, bench).collect()}
    assert got == {(4, "p"), (5, "p"), (9, "short")}
    edited = decontam.contaminated(docs, spark.createDataFrame([("near", near)], "item_id string, text string")).collect()
    assert {r["doc_id"] for r in edited} == {4, 5} and all(r["similarity"] == pytest.approx(51 / 61) for r in edited)
    many = {(r["doc_id"], r["item_id"]) for r in decontam.contaminated(docs, bench, block_chars=200).collect()}
    assert many == got
    kept = Counter(r["doc_id"] for r in decontam.decontaminate(docs, bench).collect())
    assert kept == Counter(i for i, _ in TEXTS if i not in (4, 5, 9))
    assert decontam.contaminated(none, bench).isEmpty() and decontam.contaminated(docs, bench.limit(0)).isEmpty()


def test_multi_index_finds_all_within_radius():
    index = decontam.Index([prose(40) for _ in range(50)], 0.8)
    fp = np.concatenate([index.fp ^ np.uint64(sum(1 << int(b) for b in RNG.choice(64, n, replace=False))) for n in (0, 5, decontam.RADIUS)])
    a, b = index.near(fp)
    brute = {(i, j) for i, x in enumerate(fp.tolist()) for j, y in enumerate(index.fp.tolist()) if (x ^ y).bit_count() <= decontam.RADIUS}
    assert set(zip(a.tolist(), b.tolist(), strict=True)) == brute and len(brute) >= 150


# token counts


def test_token_counts(docs, none):
    P = pytest.importorskip("public_tokenizers")
    import sentencepiece

    path = P.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    with open(path, "rb") as f:
        model = f.read()
    expected = Counter((i, len((t or "").encode()), n := len(sp.encode(t or "")), n > 4096) for i, t in TEXTS)
    assert keyed(tokcount.token_counts(docs, model, dictionary_size=50), "n_bytes", "n_tokens", "over_limit") == expected
    assert tokcount.token_counts(none, model).isEmpty()


# language


def test_language(spark, none):
    langs = {"en": ["the", "and", "ing", "of"], "de": ["der", "und", "ung", "sch"], "fr": ["le", "des", "tion", "aux"]}
    rows = [(i, " ".join(RNG.choice(langs[x], 30)), x, "s", 0, "", "") for i, x in enumerate(list(langs) * 60)] + [(1000, None, "en", "s", 0, "", ""), (1001, "12 !", None, "s", 0, "", ""), (None, "", None, None, 0, "", "")]
    df = spark.createDataFrame(rows, SCHEMA)
    got = langid.predict(df).join(df.select("doc_id", "lang"), "doc_id").collect()
    assert all(r["lang_pred"] == r["lang"] for r in got if r["doc_id"] < 1000 and r["held_out"])
    assert all((r["lang_pred"], r["score"]) == ("und", 0.0) for r in got if r["doc_id"] >= 1000)
    assert langid.predict(none).isEmpty() and langid.predict(df).count() == len(rows)


# quality


def test_quality(spark, docs, none):
    good = [(i, prose(60), None, None, 0, "", "") for i in range(150)]
    bad = [(i, " ".join(w + "###" for w in prose(60).split()), None, None, 0, "", "") for i in range(150, 300)]
    df = spark.createDataFrame(good + bad + [(900, None, None, None, 0, "", ""), (901, "", None, None, 0, "", "")], SCHEMA)
    labels = spark.createDataFrame([(i, int(i < 150)) for i in range(300)] + [(None, 1), (5, None)], "doc_id bigint, quality int")
    got = {r["doc_id"]: r for r in quality.score(df, labels).collect()}
    held = [r for r in got.values() if r["held_out"] and r["doc_id"] < 300]
    assert len(held) > 40 and all((r["predicted"] == 1) == (r["doc_id"] < 150) for r in held)
    assert got[900]["score"] == got[901]["score"] and all(0 <= r["score"] <= 1 for r in got.values())
    assert quality.score(none, labels).isEmpty() and quality.score(docs, labels.limit(0)).count() == len(TEXTS)


# language model


def test_lm(spark, docs, none):
    got = lm.score(docs, seed_docs=50)
    lower = str.maketrans({chr(65 + k): chr(97 + k) for k in range(26)})
    tokens = [(i, words((t or "").translate(lower)) + ["\n"]) for i, t in TEXTS]
    held = [common_held(i) for i, _ in TEXTS]
    c = Counter(w for (_, ws), h in zip(tokens, held, strict=True) if not h for w in ws)
    n, v = sum(c.values()), len(c)
    expected = sorted((str(i), h, len(ws), sum(c[w] > 0 for w in ws), n, round(sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws), 6)) for (i, ws), h in zip(tokens, held, strict=True))
    rows = got.collect()
    assert sorted((str(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in rows) == expected
    assert all(math.isfinite(r["score"]) and r["score"] < 0 for r in rows)
    again = Counter((str(r["doc_id"]), r["score"]) for r in lm.score(docs, seed_docs=50).collect())
    assert again == Counter((str(r["doc_id"]), r["score"]) for r in rows)
    assert lm.score(none).isEmpty()


def test_lm_trains_on_every_training_document(spark, monkeypatch):
    """Each document has a word of its own; the input vector of a word changes only where training meets it."""
    df = spark.createDataFrame([(i, f"own{i} and more", None, None, 0, "x", "") for i in range(300)], SCHEMA).repartition(6)
    seen, real = [], lm.trained

    def spied(docs, model, *args, **kwargs):
        before = model.p["x"].copy()
        out = real(docs, model, *args, **kwargs)
        seen.append((out.p["x"] != before).any(axis=1)[1 + lm.N_ENDINGS :])
        return out

    monkeypatch.setattr(lm, "trained", spied)
    assert lm.score(df, seed_docs=10).count() == 300
    assert len(seen[0]) == 2 + sum(not common_held(i) for i in range(300)) and seen[0].all()


def common_held(i) -> bool:
    import zlib

    return zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0


def test_gru_probabilities_sum_to_one_and_gradients_hold():
    model = Gru(np.arange(1.0, 13.0), hidden=4, n_classes=3)
    h = RNG.normal(size=(1, 4)).astype(np.float32)
    every = model.log_probabilities(np.repeat(h, 12, axis=0), np.arange(12))
    assert np.exp(every).sum() == pytest.approx(1, abs=1e-5)
    before = model.score([np.array([3, 5, 3, 5, 3, 5] * 20)])[0]
    for _ in range(30):
        model.train([np.array([3, 5, 3, 5, 3, 5] * 20)], lanes=1)
    assert model.score([np.array([3, 5, 3, 5, 3, 5] * 20)])[0] > 0.5 * before
    # a text's score does not depend on its neighbours or lanes
    texts = [RNG.integers(0, 12, n) for n in (5, 40, 0, 17)]
    together = model.score(texts, lanes=2, steps=7)
    assert together == pytest.approx([model.score([x])[0] for x in texts], rel=1e-4)


# rules


def test_rules(spark, docs, none):
    expected = Counter()
    for i, t in TEXTS:
        w, t = words(t), t or ""
        lines = [x for x in t.split("\n") if words(x)]
        seen = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
        rep = {k + j for k in range(len(w) - 4) if seen[tuple(w[k : k + 5])] > 1 for j in range(5)}
        failed = len(w) < 10 or 100 * len(rep) > 20 * len(w)
        expected[(i, len(w), sum(map(len, w)), sum(t.count(x) for x in "#*$%&|<>"), len(lines) - len(set(lines)), len(rep), failed, not failed)] += 1
    assert keyed(rules.quality_rules(docs), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept") == expected
    assert rules.quality_rules(none).isEmpty() and rules.clean(none).isEmpty()


def test_rules_remove_boilerplate(spark):
    line = "all rights reserved by the host of this page"
    spaced = line.replace(" ", "\t ").upper()  # white space and case don't tell lines apart
    rows = [(i, f"{prose(20)}\n {spaced if i % 2 else line.upper()}\n{prose(20)}", None, "h", 0, "x", "") for i in range(30)] + [(100, "\n".join([line] * 1 + ["a b"]), None, "h", 0, "x", ""), (101, line + " " + prose(30), None, "h", 0, "x", "")]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r["doc_id"]: r for r in rules.quality_rules(df).collect()}
    assert all(got[i]["kept"] and got[i]["n_common_chars"] == 1 + len(spaced if i % 2 else line) for i in range(30)) and not got[100]["kept"] and got[101]["n_common_chars"] == 0
    left = {r["doc_id"]: r for r in rules.clean(df).collect()}
    assert set(left) == {*range(30), 101} and all("RIGHTS" not in left[i]["text"] and left[i]["n_chars"] == len(left[i]["text"]) and left[i]["n_words"] == "x" for i in range(30))


def test_line_limit_does_not_grow_with_the_host(spark, none):
    """A line in 21 distinct texts goes on a host of any size; copies of a text count once, and other hosts are apart."""
    line = "subscribe to our letter now"
    text = [f"{prose(30)}\n{line}" for _ in range(21)]
    big = [(i, t, None, "big", 0, "x", "") for i, t in enumerate(text)] + [(100 + i, prose(25), None, "big", 0, "x", "") for i in range(400)]
    copies = [(1000 + i, text[0], None, "copies", 0, "x", "") for i in range(40)] + [(2000 + i, t, None, None, 0, "x", "") for i, t in enumerate(text[:20])]
    twice = [(3000, f"{line}\n{prose(12)}\n{line}", None, "big", 0, "x", "")] * 3 + [(None, None, None, "big", 0, "x", "")] * 2
    df = spark.createDataFrame(big + copies + twice, SCHEMA)
    got = keyed(rules.quality_rules(df), "n_common_chars", "kept")
    assert all(got[(i, len(line), True)] == 1 for i in range(21)) and all(got[(k, 0, True)] == 1 for k in [*range(1000, 1040), *range(2000, 2020), *range(100, 500)])
    assert sum(n for (i, chars, _), n in got.items() if i == 3000 and chars == 2 * len(line)) == 3 and got[(None, 0, False)] == 2
    left = Counter(r["text"].count(line) for r in rules.clean(df).filter("source = 'big'").collect())
    assert set(left) == {0} and rules.clean(df).filter("source <> 'big' or source is null").count() == 60


# mixing


def test_mixing(spark, none):
    rows = [(i, f"t{i}", None, "big" if i % 10 else None, 0, "x", "") for i in range(4000)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = mixing.mix(df, epochs=2).groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("doc_id").alias("d")).collect()
    assert {r["source"]: r["n"] for r in got} == {"big": pytest.approx(4000, rel=0.1), None: pytest.approx(4000, rel=0.1)}
    assert mixing.mix(df, {"big": 0.0}).filter("source = 'big'").isEmpty() and mixing.mix(none).isEmpty()
    # both ways to the rates agree; weights of 0 give nothing, negative ones are an error, and a large rate is met
    assert keyed(mixing.mix(df, epochs=2), "copy") == keyed(mixing.mix(df, epochs=2, broadcast_sources=0), "copy")
    one = spark.createDataFrame([(1, None, None, "a", 0, "x", ""), (None, "", None, "a", 0, "x", "")], SCHEMA)
    assert mixing.mix(one, {"a": 0.0}).isEmpty() and mixing.mix(one, epochs=900.0).count() == pytest.approx(1800, rel=0.2)
    with pytest.raises(ValueError, match="not negative"):
        mixing.mix(one, {"a": -1.0})
    a, b = (mixing.mix(df).select("doc_id", "copy").collect() for _ in range(2))
    assert a == b and a != sorted(a) and mixing.mix(df.withColumn("copy", F.lit(7))).columns == [*SCHEMA_NAMES, "copy", "mix_rate"]


SCHEMA_NAMES = [x.split()[0] for x in SCHEMA.split(", ")]


# quotes


def test_quotes(spark):
    first = "The first idea is good. It needs work."
    rows = [
        (1, 0, "a", first), (1, 1, "b", "No reply here."), (1, 2, "c", f"On Monday a wrote:\n> The first\n> idea is good.\nI agree.\n>> older words stand here."), (2, 0, "d", "> It needs work.\nFrom elsewhere."),
        (1, 3, "e", None), (None, 0, "f", "x"), (3, None, "g", "> It needs work."), (1, 2, "c2", "again"), (4, 0, "h", ""),
    ]
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id bigint, turn bigint, role string, text string, thread string")
    got = {r["role"]: r for r in quotes.link(df).collect()}
    assert len(got) == 9
    assert got["c"]["text"] == "I agree." and got["c"]["n_passages"] == 2 and got["c"]["max_level"] == 2
    assert (got["c"]["parent_turn"], got["c"]["thread"], got["c"]["depth"], got["c"]["n_linked"]) == (0, 0, 1, 1)
    assert (got["d"]["parent_conv"], got["d"]["parent_turn"], got["d"]["thread"]) == (1, 0, 0) and got["d"]["text"] == "From elsewhere."
    assert (got["b"]["parent_turn"], got["b"]["depth"]) == (0, 1) and (got["e"]["parent_turn"], got["e"]["depth"], got["e"]["text"]) == (2, 2, "")
    assert got["g"]["parent_turn"] is None and got["f"]["depth"] == 0 and got["h"]["depth"] == 0
    assert quotes.link(df.limit(0)).isEmpty()


def test_nested_quotes(spark):
    rows = [
        (1, 0, "The first idea is good. It needs work."), (1, 1, "A second thought stands here."), (1, 2, "Nothing is quoted."),
        (1, 3, "> > It needs work.\nDeep only."), (1, 4, "> A second thought stands here.\n>> The first idea is good.\n>> It needs work.\nBoth."), (1, 5, "> unknown words\n>>> A second thought stands here.\nYes."),
    ]
    df = spark.createDataFrame([(c, t, "a", x) for c, t, x in rows], "conv_id bigint, turn bigint, role string, text string")
    got = {r["turn"]: (r["parent_turn"], r["n_linked"], r["depth"]) for r in quotes.link(df).collect()}
    assert (got[3], got[4], got[5]) == ((0, 1, 1), (1, 1, 2), (1, 1, 2))
    levels = {tuple(r) for r in quotes.originals(df).collect()}
    assert levels == {(1, 3, 2, 1, 0, 1), (1, 4, 1, 1, 1, 1), (1, 4, 2, 1, 0, 2), (1, 5, 3, 1, 1, 1)}


QUOTE_ROWS = [
    (1, 2, "> The plan stands in two places.\nYes."), (1, 5, "The plan stands in two places."), (2, 0, "The plan stands in two places."),  # its own conversation has it later only
    (3, 0, "It begins."), (3, 1, "It goes on."), (3, 2, "And on."), (3, 4, "After a gap."), (3, 5000, "After a long gap."), (3, 5001, ">> It begins.\nDeep."),
    (4, 0, "> The plan stands in two places.\n>> It begins.\n>> It goes on.\nBoth levels."), (4, 1, None), (None, 0, "> Nothing known.\nx"),
]


def test_quotes_by_two_conversations_and_over_gaps(spark):
    import duckdb

    df = spark.createDataFrame([(c, t, "a", x) for c, t, x in QUOTE_ROWS], "conv_id bigint, turn bigint, role string, text string")
    got = {(r["conv_id"], r["turn"]): (r["parent_conv"], r["parent_turn"], r["n_linked"], r["thread"], r["depth"]) for r in quotes.link(df).collect()}
    assert got[1, 2] == (2, 0, 1, 2, 0) and got[3, 4] == (3, 2, 0, 0, 3) and got[3, 5000] == (3, 4, 0, 0, 4)
    assert got[3, 5001] == (3, 0, 1, 0, 1) and got[4, 0] == (1, 5, 1, 0, 0) and got[4, 1] == (4, 0, 0, 0, 1)
    conversations = df.toPandas()  # noqa: F841
    names = ["conv_id", "turn", "parent_conv", "parent_turn", "n_linked", "n_passages", "max_level", "thread", "depth", "text"]
    want = duckdb.connect().execute(f"SELECT {', '.join(names)} FROM ({quotes.OP2_SQL})").fetchall()
    assert Counter(want) == Counter(tuple(r) for r in quotes.link(df).select(names).collect())


def test_token_counts_of_random_texts():
    P = pytest.importorskip("public_tokenizers")
    import sentencepiece

    with open(P.path("piece_bpe_32k.model"), "rb") as f:
        model = f.read()
    sp, counts = sentencepiece.SentencePieceProcessor(model_proto=model), tokcount.PieceCounts(model, 500)
    parts = ["\u2581", " ", "  ", "\t", "\n", "\0", "a", "the", "The", "é", "中", "<s>", "</s>", "<unk>", "<0x41>", "\u00a0", "\u3000", "😀", "ing", ".", "1"]
    for _ in range(6000):
        text = "".join(RNG.choice(parts, RNG.integers(0, 9)))
        assert counts.count(text) == len(sp.encode(text)), repr(text)


def test_wavelet_matrix_ranks():
    seq = RNG.zipf(1.4, 3000) % 700
    tree = WaveletMatrix(seq, 701)
    symbol, lo, hi = seq[:400], RNG.integers(0, 3000, 400), RNG.integers(0, 3001, 400)
    a, b = tree.rank2(symbol, lo, hi)
    shift = tree.offsets()[symbol]
    for k, s in enumerate(symbol):
        assert (a[k] - shift[k], b[k] - shift[k]) == ((seq[: lo[k]] == s).sum(), (seq[: hi[k]] == s).sum())
    assert tree.nbytes * 8 / len(seq) < 1.5 * tree.n_levels


def test_decontamination_does_not_depend_on_blocks_and_keeps_windows(spark):
    """Items edited in documents: all windows of similarity 0.8 or more by plain counting are found, however the benchmark is cut."""
    items = [prose(int(n)) for n in RNG.integers(12, 90, 60)]
    items += [items[0] + " " + prose(3)]
    texts = []
    for k, x in enumerate(items * 3):
        w = x.split()
        for at in RNG.choice(len(w), int(RNG.integers(0, 1 + len(w) // 25)), replace=False):
            w[at] = f"x{RNG.integers(10**6)}"
        texts.append(f"{prose(20)} {' '.join(w)} {prose(20)}")
    df = spark.createDataFrame([(i, t, None, None, 0, "x", "") for i, t in enumerate(texts)], SCHEMA)
    bench = spark.createDataFrame([*enumerate(items), (0, items[0])], "item_id int, text string")
    runs = [{(r["doc_id"], r["item_id"], r["start_word"], round(r["similarity"], 12)) for r in decontam.contaminated(df, bench, block_chars=n).collect()} for n in (10**7, 3000)]
    assert runs[0] == runs[1]
    grams = lambda w: Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    shingles = [grams(x.split()) for x in items]
    df_of = Counter(g for s in shingles for g in s)
    weigh = lambda g: round(16 * math.log1p(len(items) / max(df_of[g], 1))) if g in df_of else round(16 * math.log1p(len(items)))
    want = {}
    for d, t in enumerate(texts):
        w = t.split()
        for i, s in enumerate(shingles):
            size = len(items[i].split())
            for p in range(len(w) - size + 1):
                own = grams(w[p : p + size])
                if both := sum(weigh(g) * min(n, s[g]) for g, n in own.items() if g in s):
                    similar = both / (sum(weigh(g) * n for g, n in s.items()) + sum(weigh(g) * n for g, n in own.items()) - both)
                    if similar >= 0.8:
                        want[d, i] = max(want.get((d, i), 0), similar)
    found = {(d, i) for d, i, _, _ in runs[0]}
    assert found <= set(want) and len(found) >= 0.97 * len(want) and len(want) > 100
