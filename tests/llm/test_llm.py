"""Each operator against a brute-force version or SQL, and on edge tables."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SF, same_rows
from fuzzcurve.llm import bpe, chat, decontaminate, graph, jaccard, language, packing, quality, registry, substring, suffix, urls
from fuzzcurve.llm.common import drop_tables, read, write_table

WORDS = [a + b for a in "ka lo mi nu re st ta ve wo xi".split() for b in "ba de fi go hu".split()]


def prose(rng, n):
    out = [rng.choice(WORDS) + str(rng.randrange(40)) for _ in range(n)]
    return " ".join(w + ("\n" if i % 17 == 16 else "") for i, w in enumerate(out))


def edited(rng, text, share):
    w = text.split(" ")
    for i in rng.sample(range(len(w)), max(1, int(len(w) * share))):
        w[i] = "zz" + str(rng.randrange(10**6))
    return " ".join(w)


@pytest.fixture(scope="module")
def corpus():
    """(doc_id, text): unique texts, copies, near copies, shared passages, short, empty and null ones."""
    rng = random.Random(3)
    base = [prose(rng, rng.randrange(60, 200)) for _ in range(25)]
    passage = prose(rng, 60)
    texts = [*base, *base[:4], *[edited(rng, base[5], 0.01) for _ in range(12)], *[edited(rng, base[6], s / 100) for s in range(1, 8)]]
    texts += [t[: len(t) // 2] + " " + passage + " " + t[len(t) // 2 :] for t in base[10:16]]
    texts += [None, "", " \n\t ", "one two three", "One two THREE", "one two", "- " * 300, "a" * 400, "a" * 400, "é" * 120 + "x", "a\x0bb\x0cc d e f g", "x" * 70_000]
    return list(enumerate(texts))


@pytest.fixture(scope="module")
def docs(spark, corpus):
    """The corpus among columns whose names clash, with a repeated row and rows without an id."""
    rows = [(i, t, "en", "s", len(t or ""), *["x"] * 7) for i, t in [*corpus, corpus[8], (None, corpus[9][1]), (None, None)]]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, rest string, n_words string, kept string, h string, row string, place string, contaminated string").repartition(3)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("false")


def digest(words):
    return hashlib.sha256(" ".join(words).encode()).hexdigest()


def ascii_words(text):
    return (text or "").encode().split()


def thue_morse(n):
    """Strings that polynomial hashes modulo a power of two cannot tell apart."""
    x = "".join("ab"[bin(i).count("1") & 1] for i in range(n))
    return x, x.translate(str.maketrans("ab", "ba"))


def test_hashes_do_not_collide_by_form(spark):
    x, y = thue_morse(1024)
    df = lambda *texts: spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    lines, repeats = quality.quality_report(df(f"{x}\n{y}", f"{x} c d e {y} c d")).orderBy("doc_id").collect()
    assert lines["n_dup_lines"] == 0 and repeats["n_repeat_words"] == 0
    assert [r["component_id"] for r in jaccard.jaccard_components(df(x, y)).orderBy("doc_id").collect()] == [0, 1]
    words = [" ".join([w] * 13) for w in (x, y)]
    assert all(r["n_removed"] == 0 for r in substring.substring_dedup(df(*words)).collect())
    a, b = thue_morse(64)
    sequences = [" ".join(w for w in t) for t in (a, b)]  # the same at the level of words, in one line
    rows = [(i, sequences[i % 2], "h") for i in range(8)]
    report = quality.quality_report(spark.createDataFrame(rows, "doc_id long, text string, source string"), min_docs=5, share=0.0).collect()
    assert all(r["n_removed_words"] == 0 for r in report)
    got = suffix.suffix_dedup(df(x, y)).collect()
    assert [(r["n_removed"], bytes(r["kept"])) for r in sorted(got, key=lambda r: r["doc_id"])] == [brute_bytes([(0, x), (1, y)])[i][1::2] for i in (0, 1)]


# 1


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_equals_sql(spark, duck, name):
    same_rows(registry.QUERIES[name](spark, SF), duck.execute(registry.ORACLES[name]).df())


def test_line_frequency(spark):
    rng = random.Random(1)
    body = lambda: prose(rng, 60)
    hot = "The  SAME line of every host"
    rows = [(i, body() + "\n" + (hot if i % 2 else hot.lower().replace("  ", " ")) + "\n" + body(), "h") for i in range(8)]
    rows += [(8, hot + "\n" + "\n".join([hot] * 12), "h"), (9, body() + "\n" + hot, "other"), (10, None, None), (11, body(), None)]
    copies = body() + "\nonly in copies"
    rows += [(20 + i, copies, "h") for i in range(9)] + [(29, copies, "h")] * 3
    rows += [(40, hot + "\n" + body(), "few"), (40, body() + "\n" + hot, "few"), (None, hot + "\n" + body(), "few")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    everything = quality.quality_report(df, min_docs=5, share=0.0).collect()
    assert len(everything) == len(rows)
    got = {r["doc_id"]: r for r in everything}
    assert [got[i]["n_removed_words"] for i in (0, 1, 7)] == [0, 6, 6]  # the first keeps its line
    assert got[8]["depleted"] and got[8]["n_dup_lines"] == 12 and not got[8]["kept"]
    assert got[9]["n_removed_words"] == 0 and got[10]["base_failed"] and got[11]["kept"]
    assert [got[20 + i]["kept"] for i in range(10)] == [True] + [False] * 9  # copies are documents; the first keeps its lines
    assert got[40]["n_removed_words"] == got[None]["n_removed_words"] == 0  # two documents there
    gone = {r["doc_id"]: r["n_removed_words"] for r in quality.quality_report(df, min_docs=5, share=0.0, keep_first=False).collect()}
    assert gone[0] == 6 and gone[20] == len(copies.split())
    most = {r["doc_id"]: r["n_removed_words"] for r in quality.quality_report(df, share=0.9, min_docs=2, most_docs=5).collect()}
    assert most[1] == 6
    out = {r["doc_id"]: r["text"] for r in quality.quality_filter(df, min_docs=5, share=0.0).collect()}
    assert 8 not in out and 10 not in out and hot.split()[1] not in out[3].split() and out[0] == rows[0][1]
    twins = spark.createDataFrame([(1, body(), "h"), (1, "too short", "h"), (None, "short too", "h"), (None, body(), "h")], df.schema)
    kept = quality.quality_filter(twins).collect()  # each text has its own verdict, with or without an id
    assert sorted(str(r["doc_id"]) for r in kept) == ["1", "None"] and all(len(r["text"].split()) == 60 for r in kept)


# 2


def brute_components(rows, k=5, percent=80):
    sets = {}
    for i, t in rows:
        w = [x.lower() for x in ascii_words(t)]
        sets[i] = {tuple(w[a : a + k]) for a in range(max(1, len(w) - k + 1))} if w else set()
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for x, i in enumerate(ids):
        for j in ids[x + 1 :]:
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: (len(sets[i]), find(i)) for i in ids}


def test_jaccard(corpus, docs):
    got = jaccard.jaccard_components(docs).collect()
    assert len(got) == docs.count()
    want = brute_components(corpus)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got if r["doc_id"] is not None} == want
    assert all(r["component_id"] is None for r in got if r["doc_id"] is None)


def without_groups(monkeypatch):
    """Without the first grouping, the matrix alone finds every link."""
    none = lambda known, reps, *_: (reps.select(F.col("doc_id").alias("a"), F.col("doc_id").alias("b")).where("false"), reps.select(F.col("doc_id").alias("id"), F.col("doc_id").alias("component")).where("false"))
    monkeypatch.setattr(jaccard, "_grouped", lambda *a: tuple(write_table(x, "none") for x in none(*a)))


def test_jaccard_links_that_no_band_finds(spark, monkeypatch):
    rng = random.Random(5)
    base = prose(rng, 150)
    rows = [(i, edited(rng, base, 0.015)) for i in range(12)] + [(20 + i, prose(rng, 90)) for i in range(5)]
    without_groups(monkeypatch)
    got = jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute_components(rows)


def test_jaccard_opens_groups_in_chunks(spark, monkeypatch):
    """Large groups that other documents ask: chunks of members, blocks of queries."""
    rng = random.Random(7)
    base = prose(rng, 150)
    rows = [(i, edited(rng, base, 0.015)) for i in range(60)] + [(100 + i, edited(rng, base, 0.04)) for i in range(30)]
    for name, value in (("CHUNK", 7), ("ASKERS", 3), ("PANEL", 2)):
        monkeypatch.setattr(jaccard, name, value)
    got = jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute_components(rows)


def test_jaccard_family_growth(spark, monkeypatch):
    """Twice as many near copies, of which only one pair in ten links, open at most twice as many pairs."""
    opened, real = [], jaccard._links

    def counted(sets, asked, members, percent):
        opened[-1] += asked.select("q", "grp").join(members.select("grp", "doc_id"), "grp").count()
        return real(sets, asked, members, percent)

    monkeypatch.setattr(jaccard, "_links", counted)
    for n in (200, 400):
        rng = random.Random(11)
        base = prose(rng, 150)
        rows = [(i, edited(rng, base, 0.014)) for i in range(n)]
        opened.append(0)
        got = jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
        assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute_components(rows)
    assert opened[1] <= 2 * opened[0] + 200 and opened[1] < 400 * 100, opened


def test_jaccard_hot_tokens(spark, monkeypatch):
    """Rows of hot tokens are dealt in cells, questions go out in parts, and every link is found."""
    rng = random.Random(6)
    shared = [prose(rng, 12) for _ in range(6)]  # texts of shared passages: nearly all shingles are common
    rows = [(i, " ".join(rng.sample(shared, 5)) + " " + prose(rng, 3)) for i in range(60)]
    rows += [(100 + i, edited(rng, rows[i][1], 0.01)) for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for name, value in (("SAMPLE", 1), ("HOT", 3), ("BLOCK", 5), ("QUESTIONS", 7)):
        monkeypatch.setattr(jaccard, name, value)
    without_groups(monkeypatch)
    seen, real = [], jaccard._matrix
    monkeypatch.setattr(jaccard, "_matrix", lambda *a: seen.append(write_table(real(*a), "matrix")) or seen[-1])
    got = jaccard.jaccard_components(df).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute_components(rows)
    of = seen[0].groupBy("token", "i", "j").agg(F.count("*").alias("c"), F.min("side").alias("side")).toPandas()
    hot = of[of["side"] < 2]
    assert hot.groupby("token").size().max() > 4 and hot["c"].max() <= 40


def test_first_shared_tokens_stand_in_both_prefixes():
    """In linked sets, the first tokens in common stand where questions are asked, whatever the order of tokens."""
    rng = random.Random(13)
    for _ in range(3000):
        n = rng.randrange(1, 200)
        a = set(range(n))
        b = set(rng.sample(range(n), n - rng.randrange(0, n // 5 + 1))) | {n + i for i in range(rng.randrange(0, n // 5 + 1))}
        m = len(b)
        if not b or 100 * len(a & b) < 80 * len(a | b):
            continue
        order = list(range(2 * n + 1))
        rng.shuffle(order)
        if rng.random() < 0.5:  # those in common come last
            order.sort(key=lambda t: t in a & b)
        at = [{t: i for i, t in enumerate(t for t in order if t in x)} for x in (a, b)]
        count, common = int(jaccard.first_shared(n, m)), int(jaccard.common_tokens(n, m, 80))
        assert len(a & b) >= common
        for t in [t for t in order if t in a & b][:count]:
            for x, size in zip(at, (n, m)):
                assert x[t] < size - common + count <= jaccard.prefix_length(np.array(size), 80)


def test_components(spark):
    rng = random.Random(2)
    links = [(i, i + 1) for i in range(0, 60)] + [(100 + rng.randrange(40), 100 + rng.randrange(40)) for _ in range(30)]
    root = {}

    def find(i):
        root.setdefault(i, i)
        while root[i] != i:
            i = root[i]
        return i

    for a, b in links:
        if a != b:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    got = {r["id"]: r["component"] for r in graph.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: find(i) for i in root}


# 3


def test_url_edges(spark):
    rows = [(1, None), (2, "no scheme/cheap-pills"), (3, "HTTP://A.Example.ORG:80/es/x?q#f"), (4, "http://example.org"), (5, "http://example.org?x=/es/"), (6, "x://y.com/de/://z"), (7, "http://notexample.org/en/12"), (8, "http://casino.net/"), (9, "http://mycasino.net/"), (10, "http://adult-x.net/a/health/"), (11, "http://adult-x.net/a"), (1, None), (12, "")]
    got = {r["page_id"]: tuple(r)[1:5] for r in urls.url_verdicts(spark.createDataFrame(rows, "page_id long, url string"), urls.rule_table(spark)).collect()}
    assert got == {
        1: ("", "", None, "allow"), 2: ("", "", None, "block"), 3: ("a.example.org:80", "/es/x", None, "allow"), 4: ("example.org", "", None, "allow"), 5: ("example.org", "", None, "allow"),
        6: ("y.com", "/de/://z", "com/de/", "block"), 7: ("notexample.org", "/en/12", "org/", "allow"), 8: ("casino.net", "/", None, "block"), 9: ("mycasino.net", "/", None, "allow"),
        10: ("adult-x.net", "/a/health/", None, "allow"), 11: ("adult-x.net", "/a", None, "block"), 12: ("", "", None, "allow"),
    }


def test_few_rules_run(spark):
    runs = urls.url_verdicts(read(spark, SF, "pages"), urls.rule_table(spark)).agg(F.avg("n_rules_run")).first()[0]
    assert runs < len(urls.HOST_RULES + urls.PATTERN_RULES) / 2


def test_only_rules_with_a_token_run(spark):
    rng = random.Random(14)
    names = ["".join(rng.choice("abcdefghij") for _ in range(8)) for _ in range(9000)]
    rules = [(f"{n}.com/", "host", "block") for n in names[:5000]] + [(f"^{n}^", "pattern", "block") for n in names[5000:8000]] + [(f"^{n}", "pattern", "allow") for n in names[8000:]]
    rules += [("^porn", "pattern", "block"), ("^p*^q^", "pattern", "block")]
    rules = spark.createDataFrame(rules, "rule string, kind string, verdict string")
    rows = [(1, "http://a.b/c"), (2, "http://pornography.net/"), (3, f"http://www.{names[0]}.com/x"), (4, f"http://x.org/{names[5000]}-1"), (5, f"http://x.org/{names[5000]}/{names[8000]}abc"), (6, f"http://{names[8000]}.org/"), (7, "http://x.org/p/q/"), (8, "http://x.org/" + "p/" * 20_000), (8, "http://x.org/" + "p/" * 20_000)]
    pages = spark.createDataFrame([(i, u, "x", "y") for i, u in rows], "page_id long, url string, rule string, token string")
    got = {r["page_id"]: (r["rule"], r["verdict"], r["n_rules_run"]) for r in urls.url_verdicts(pages, rules).collect()}
    assert got == {1: (None, "allow", 0), 2: (None, "block", 1), 3: (f"{names[0]}.com/", "block", 1), 4: (None, "block", 1), 5: (None, "allow", 2), 6: (None, "allow", 1), 7: (None, "block", got[7][2]), 8: (None, "allow", got[8][2])}
    assert got[7][2] == 1 and got[8][2] <= 1
    assert [r["verdict"] for r in urls.url_verdicts(pages, rules.where("false")).collect()] == ["allow"] * len(rows)


# 4 and 10


@pytest.fixture(scope="module")
def tiktoken_encode():
    import public_tokenizers
    import tiktoken

    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.Vocabulary(bpe.rank_file()).ranks, special_tokens={}).encode_ordinary


def test_bpe_equals_library(spark, docs, tiktoken_encode):
    rng = random.Random(4)
    letters = " \n\t'  abstdmrvel0123.,-éß中　\xa0👍ñ١Ⅷ"
    odd = ["", "'s", "a's b're  x", "we'll'd", "x" * 500 + " " * 300, "".join(rng.choice("abcdeé") for _ in range(5000))] + ["".join(rng.choice(letters) for _ in range(rng.randrange(40))) for _ in range(3000)]
    df = docs.select("doc_id", "text", "rest").unionByName(spark.createDataFrame([(100 + i, t, "") for i, t in enumerate(odd)], "doc_id long, text string, rest string"))
    for r in bpe.decode(bpe.encode(df)).collect():
        text = r["text"] or ""
        assert np.frombuffer(r["ids"], "<u4").tolist() == tiktoken_encode(text)
        assert r["decoded"] == text.encode() and set(r.asDict()) == {"doc_id", "text", "rest", "ids", "decoded"}


def test_fold_with_higher_order_functions(spark, tiktoken_encode):
    words = ["", "a", " the", " ciónmente", "'ll", "\n\n", " Retition", "中文字", "0123456789"]
    for r in spark.createDataFrame([(w,) for w in words], "w string").select("w", bpe.fold_words(F.col("w")).alias("ids")).collect():
        assert r["ids"] == tiktoken_encode(r["w"])


def test_packing_is_lossless(spark, docs, tiktoken_encode):
    packed = packing.pack(docs, row_len=64).cache()
    want = sorted((str(i), tiktoken_encode(t or "") + [50256]) for i, t in docs.select("doc_id", "text").collect())
    assert sorted((str(r["doc_id"]), r["ids"]) for r in packing.unpack(packed.where("true")).collect()) == want  # repeated rows and those without an id too
    for r in packed.collect():
        cuts = r["cu_seqlens"]
        resets = np.unpackbits(np.frombuffer(r["position_resets"], np.uint8), bitorder="little")
        assert len(r["ids"]) == 128 and cuts[-1] == r["n_ids"] <= 64 and np.flatnonzero(resets).tolist() == cuts[:-1]
        assert len(r["doc_ids"]) == len(r["doc_rows"]) == len(r["pieces"]) == len(cuts) - 1


def test_best_fit_decreasing():
    rng = np.random.default_rng(1)
    sizes = rng.integers(1, 33, 400)
    free, want = [], []
    for i in sorted(range(400), key=lambda i: -sizes[i]):
        fits = [c for c in free if c >= sizes[i]]
        if fits:
            free.remove(min(fits))
            free.append(min(fits) - sizes[i])
        else:
            want.append(i)
            free.append(32 - sizes[i])
    rows = packing.best_fit_decreasing(sizes, 32)
    assert sorted(i for r in rows for i in r) == list(range(400)) and len(rows) == len(want)
    assert sorted(32 - sum(int(sizes[i]) for i in r) for r in rows) == sorted(map(int, free))


# 5


def test_language(spark):
    out = registry.QUERIES["op5_language"](spark, SF).join(read(spark, SF, "documents").select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in out if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1 for r in out)
    assert sum(r["lang"] == r["lang_pred"] for r in held) >= 0.95 * len(held)


def test_language_edges(spark, docs, empty):
    dictionaries = language.fit(docs)
    assert set(dictionaries) == {"en"} and language.fit(empty) == {}
    assert language.identify(docs, dictionaries).count() == docs.count() and language.identify(empty, dictionaries).count() == 0
    edges = spark.createDataFrame([(1, None), (2, ""), (3, "123 ?!"), (4, "word")], "doc_id long, text string")
    assert [r["lang_pred"] for r in language.identify(edges, dictionaries).orderBy("doc_id").collect()] == ["und", "und", "und", "en"]
    assert [r["lang_pred"] for r in language.identify(edges, {}).collect()] == ["und"] * 4


def brute_language(rows, asked, sample_docs=150, sample_chars=4000, dict_bytes=100_000, hashes=None):
    """Predictions by a plain loop: dictionaries from the rows of least hash, blocks compressed one by one."""
    import zstandard

    tools = {}
    for lang in sorted({lang for _, t, lang in rows if t is not None and lang is not None}):
        own = sorted((hashes[i, t], t[:sample_chars]) for i, t, x in rows if x == lang and t is not None)[:sample_docs]
        raw = b""
        for k, (_, t) in enumerate(own):
            if len(raw) - k + 1 < dict_bytes:
                raw += (b" " if k else b"") + language.normalise(t).encode()
        d = zstandard.ZstdCompressionDict(raw[:dict_bytes], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(level=6)
        tools[lang] = zstandard.ZstdCompressor(level=6, dict_data=d, write_content_size=False, write_dict_id=False)
    out = []
    for text in asked:
        raw = language.normalise(text or "").encode()
        if not any(c.isalpha() for c in text or ""):
            out.append(("und", 0.0))
            continue
        size = sorted((sum(len(z.compress(raw[j : j + 4096])) for j in range(0, len(raw), 4096)), lang) for lang, z in tools.items())
        out.append((size[0][1], 1 - size[0][0] / size[1][0] if len(size) > 1 else 1.0))
    return out


def test_language_equals_a_loop(spark):
    """Whole small table, with repeated rows, null and very long texts, and ties."""
    own = read(spark, SF, "documents").select("doc_id", "text", "lang")
    long = " ".join(r["text"] for r in own.where("lang = 'fr' and text is not null").limit(60).collect())
    more = spark.createDataFrame([(10**6, long, "fr"), (10**6, long, "fr"), (10**6 + 1, None, "fr"), (10**6 + 2, "", None), (10**6 + 3, "zz", None)], own.schema)
    docs = own.unionByName(more)
    seen = docs.where(~language.held_out(F.col("doc_id"))).select("doc_id", "text", "lang", F.xxhash64("doc_id", "text").alias("h")).collect()
    rows = docs.collect()
    want = brute_language([(r["doc_id"], r["text"], r["lang"]) for r in seen], [r["text"] for r in rows], hashes={(r["doc_id"], r["text"]): r["h"] for r in seen})
    got = language.identify(docs, language.fit(docs.where(~language.held_out(F.col("doc_id"))))).collect()
    key = lambda x: (x[0], x[1], round(x[2], 12))
    assert sorted(map(key, ((r["doc_id"], r["lang_pred"], r["score"]) for r in got))) == sorted(map(key, ((r["doc_id"], *w) for r, w in zip(rows, want))))


def test_language_beyond_64(spark):
    """Rare languages have a dictionary too, and predictions are of all of them."""
    rng = random.Random(12)
    own = {f"l{i:02}": ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(8)) for _ in range(12)] for i in range(70)}
    text = lambda lang: " ".join(rng.choice(own[lang]) for _ in range(40))
    rows = [(i, text(lang), lang) for i, lang in enumerate([*own, *list(own)[:64]])]
    dictionaries = language.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert set(dictionaries) == set(own)
    asked = spark.createDataFrame([(i, text(lang)) for i, lang in enumerate(own)], "doc_id long, text string")
    assert [r["lang_pred"] for r in language.identify(asked, dictionaries).orderBy("doc_id").collect()] == list(own)


# 6


def test_decontamination(spark, docs, empty):
    rng = random.Random(9)
    items = [prose(rng, n) for n in (14, 20, 37, 59)] + [None, "", "short one"]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    swap = lambda text, every: " ".join("qq" if i % every == every - 1 else w.upper() for i, w in enumerate(text.split()))
    rows = [(i, prose(rng, 80) + " " + swap(items[i % 4], 7 if i % 4 else 15) + " " + prose(rng, 80)) for i in range(8)]
    rows += [(20 + i, prose(rng, 200)) for i in range(10)] + [(40, None), (41, ""), (42, "short one"), (43, items[2]), (None, items[2])]
    got = {r["doc_id"]: r for r in decontaminate.find_contamination(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect() if r["doc_id"] is not None}
    assert {i for i, r in got.items() if r["contaminated"]} == {*range(8), 43}
    assert all(got[i]["items"] == [i % 4] for i in range(8))
    assert decontaminate.decontaminated(docs, bench).columns == docs.columns and decontaminate.decontaminated(empty, bench).count() == 0
    assert decontaminate.find_contamination(docs, bench.where("false")).where("contaminated").count() == 0


def best_stretch(equal):
    """Equal words of the stretch that scores best, of all stretches; None is outside the document."""
    best = (0, 0, 0)
    for a in range(len(equal)):
        score = same = 0
        for z in range(a, len(equal)):
            if equal[z] is None:
                break
            score, same = score + (1 if equal[z] else -3), same + bool(equal[z])
            best = max(best, (score, a - z - 1, same))
            if score <= 0:
                break
    return best[2]


def brute_contamination(rows, items):
    """All alignments of all items with all documents."""
    out = {}
    for i, text in rows:
        doc = np.array([hash(w.lower()) for w in ascii_words(text)], np.int64)
        found = set()
        for item_id, item in items:
            own = np.array([hash(w.lower()) for w in ascii_words(item)], np.int64)
            if len(own) >= 3 and any(best_stretch([doc[shift + k] == own[k] if 0 <= shift + k < len(doc) else None for k in range(len(own))]) >= min(13, -(-len(own) * 4 // 5)) for shift in range(-len(own), len(doc) + 1)):
                found.add(item_id)
        out[i] = sorted(found)
    return out


@pytest.mark.parametrize("often", [16, 0])
def test_decontamination_equals_all_alignments(spark, monkeypatch, often):
    monkeypatch.setattr(decontaminate, "OFTEN", often)  # 0: every seed takes further words along
    rng = random.Random(21)
    items = [(k, prose(rng, rng.choice([3, 4, 6, 9, 13, 15, 16, 20, 40]))) for k in range(30)]
    items += [(29, items[0][1] + " more words here"), (40, "in the middle of the")]  # a repeated id, a common phrase
    rows = []
    for i in range(80):
        w = items[rng.randrange(30)][1].split()
        for at in rng.sample(range(len(w)), rng.randrange(0, max(1, len(w) // 5) + 1)):
            w[at] = f"qq{at}"
        cut = rng.randrange(0, 3)
        rows.append((i, " ".join([prose(rng, rng.randrange(0, 40)), *w[cut:], "in the middle of the", prose(rng, 20)])))
    rows += [(90, " ".join(prose(rng, 30_000).split() + items[7][1].split())), (91, None)]
    df = spark.createDataFrame([*rows, rows[3]], "doc_id long, text string")
    got = decontaminate.find_contamination(df, spark.createDataFrame(items, "item_id long, text string")).collect()
    want = brute_contamination(rows, items)
    assert len(got) == len(rows) + 1 and {r["doc_id"]: r["items"] for r in got} == want
    assert sum(map(bool, want.values())) > 30


def test_masks_hit_with_two_more_words_near():
    """No stretch of any length with 13 equal words escapes the masks with two further equal words within NEAR of the window.

    The states of a growing stretch that has no such hit yet: its last words,
    its score, the best score so far and its equal words. They are few.
    """
    near, masks = decontaminate.NEAR, [(len(m), int(m, 2)) for m in decontaminate.MASKS]
    keep = 11 + 2 * near

    def hit(x, n, after):
        for size, mask in masks:
            if n >= size + after and x >> after & mask == mask:
                left = x >> after + size & (1 << max(0, min(near, n - size - after))) - 1
                if ((x & (1 << after) - 1).bit_count() + left.bit_count()) >= 2:
                    return True
        return False

    todo = [(1, 1, 1, 1, 1)]
    seen = set(todo)
    while todo:
        x, n, score, most, equal = todo.pop()
        for bit in (0, 1):
            own = ((x << 1 | bit) & (1 << keep) - 1, min(n + 1, keep), score + (1 if bit else -3), max(most, score + 1 if bit else 0), min(13, equal + bit))
            if own[2] <= 0 or hit(own[0], own[1], near):
                continue
            if bit and own[2] > most and own[4] == 13:  # it may end here
                assert any(hit(own[0], own[1], after) for after in range(near)), bin(own[0])
            if own not in seen:
                seen.add(own)
                todo.append(own)
        assert len(seen) < 100_000
    from itertools import product

    for n in (6, 7, 8, 9, 10, 11, 12, 13, 14, 15):  # shorter items: fewer equal words, windows of 4, or the masks at 15
        need = -(-4 * n // 5)
        width = [(4, 15)] if n < 15 else masks
        more = int(decontaminate.further(np.array([n]), np.array([0 if n == 15 else 3]), 3)[0])
        for size in range(need, n + 1):
            for x in product((0, 1), repeat=size):
                total = [sum(1 if b else -3 for b in x[: k + 1]) for k in range(size)]
                if sum(x) >= need and min(total) > 0 and all(total[-1] > v for v in total[:-1]):
                    value = int("".join(map(str, x)), 2)
                    ok = any(value >> after & mask == mask and (value & (1 << after) - 1 & -1 << max(0, after - near)).bit_count() + (value >> after + w & (1 << near) - 1).bit_count() >= more for w, mask in width for after in range(size - w + 1))
                    assert ok, (n, x)


def test_shared_phrases_do_not_pair_all(spark):
    """Items that begin with one template, documents that hold it: as many diagonals as there are copies, not items times documents."""
    rng = random.Random(31)
    template = prose(rng, 12).replace("\n", "").split()[:11]
    for n in (60, 120):
        items = [(k, " ".join([*template, *prose(rng, 25).split()])) for k in range(n)]
        rows = [(i, " ".join([*prose(rng, 20).split(), *template, *prose(rng, 20).split()])) for i in range(n)]
        rows += [(1000 + i, " ".join([*prose(rng, 20).split(), *items[i][1].split()[: 13 + i % 5]])) for i in range(0, n, 10)]
        df, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
        made = write_table(decontaminate._diagonals(df, write_table(decontaminate._items(bench), "items"), decontaminate.MASKS, 3), "made")
        assert made.count() <= n
        got = {r["doc_id"]: r["items"] for r in decontaminate.find_contamination(df, bench).where("contaminated").collect()}
        assert got == {1000 + i: [i] for i in range(0, n, 10)}


def test_masks_hit_every_stretch():
    """No stretch of up to 20 words that counts escapes the masks."""
    from itertools import combinations

    for need, most in ((12, 15), (13, 20)):
        for size in range(need, most + 1):
            for k in range(size - need + 1):
                for gone in combinations(range(size), k):
                    x = np.array([i not in gone for i in range(size)])
                    total = np.cumsum(np.where(x, 1, -3))
                    if (total > 0).all() and (np.cumsum(np.where(x, 1, -3)[::-1]) > 0).all():
                        assert any(all(x[a + j] for j, c in enumerate(m) if c == "1") for m in decontaminate.MASKS for a in range(size - len(m) + 1))


def test_common_phrases_are_no_seeds(spark):
    rng = random.Random(22)
    items = spark.createDataFrame([(k, f"{prose(rng, 12)} in the middle of the {prose(rng, 12)}") for k in range(40)], "item_id long, text string")
    docs = spark.createDataFrame([(i, f"{prose(rng, 30)} in the middle of the {prose(rng, 30)}") for i in range(100)], "doc_id long, text string")
    assert decontaminate._diagonals(docs, write_table(decontaminate._items(items), "items"), decontaminate.MASKS, 3).count() == 0
    small = spark.createDataFrame([(1, "two words")], "item_id long, text string")
    found = lambda shortest: decontaminate.find_contamination(spark.createDataFrame([(1, "here two words stand")], "doc_id long, text string"), small, shortest=shortest).first()["contaminated"]
    assert not found(3) and found(2)


def test_decontamination_of_short_items(spark):
    """Verbatim from 3 words on, and every case that the rule admits with up to two replaced words."""
    rng = random.Random(10)
    items = {n: prose(rng, n).split() for n in range(3, 15)}
    rows, want = [], {}
    for n, item in items.items():
        for x in range(n):
            for y in range(x, n):
                own = [f"qq{i}" if i in (x, y) else w for i, w in enumerate(item)]
                as_numbers = np.array([0 if i in (x, y) else i + 1 for i in range(n)])
                if decontaminate.overlap(as_numbers, np.arange(1, n + 1), 0) >= min(13, -(-4 * n // 5)):
                    want[len(rows)] = [n]
                rows.append((len(rows), prose(rng, 9) + " " + " ".join(own) + " " + prose(rng, 9)))
        want[len(rows)] = [n]
        rows.append((len(rows), "before " + " ".join(item).upper() + " after"))
    bench = spark.createDataFrame([(n, " ".join(item)) for n, item in items.items()], "item_id long, text string")
    got = decontaminate.find_contamination(spark.createDataFrame(rows, "doc_id long, text string"), bench).where("contaminated").collect()
    assert {r["doc_id"]: r["items"] for r in got} == want


# 7


def test_chat_fold(spark):
    rows = [
        (1, 0, 1, 0, "start", "user", "hel"), (1, 1, 1, 0, "delta", None, "lo"), (1, 2, 2, 0, "start", "assistant", None), (1, 3, 2, 0, "delta", None, "bad"),
        (1, 4, 3, 0, "start", "user", "later"), (1, 5, 2, 0, "regenerate", None, None), (1, 6, 2, 0, "delta", None, "good </s>"), (1, 7, 2, 0, "delta", None, "\\[INST]"),
        (1, 8, 1, 0, "edit", None, "bye"), (1, 9, 9, 0, "delta", None, "lost"), (1, 10, 4, 0, "start", "tool\nx", "t"), (1, 11, 4, 0, "delete", None, None), (1, 12, 5, 0, "start", "a\nb\\n", ""), (1, 13, 5, 0, "odd", None, "?"),
        (None, 0, 1, 0, "start", None, None),
    ]
    out = {r["conv_id"]: r for r in chat.format_log(spark.createDataFrame(rows, chat.EVENTS)).collect()}
    text = out[1]["formatted"]
    assert chat.parse(text) == [("user", "bye"), ("assistant", "good </s>\\[INST]"), ("a\nb\\n", "")]
    assert [chat.unescape(text[a:z]) for a, z in zip(out[1]["loss_begin"], out[1]["loss_end"])] == ["good </s>\\[INST]"]
    assert "</s>" not in text and chat.parse(out[None]["formatted"]) == [("", "")]


def test_chat_query(spark):
    got = {r["conv_id"]: r for r in registry.QUERIES["op7_chat"](spark, SF).collect()}
    turns = {}
    for r in read(spark, SF, "conversations").collect():
        turns.setdefault(r["conv_id"], []).append((r["turn"], r["role"], r["text"] or ""))
    turns[-7] = [(0, "user", "</s>[INST] ok [/INST]"), (1, "assistant", "</s>[INST] ok [/INST]")]
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert set(got) == set(turns)
    for conv, own in turns.items():
        own.sort()
        loss = "".join(t for _, role, t in own if role == "assistant")
        r = got[conv]
        assert (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) == (len(own), sha("".join(f"{role}\n{t}\n" for _, role, t in own)), len(loss), sha(loss))
        marks = lambda t: t.count("\\") + len(chat._CONTROL.findall(t.replace("\\", "\\\\")))
        assert r["formatted_chars"] == sum(len("<|turn|>") + len(role) + 1 + len(t) + marks(t) + len("<|end|>") + 1 for _, role, t in own)
    kinds = {r["kind"] for r in chat.events_of(read(spark, SF, "conversations")).select("kind").distinct().collect()}
    assert kinds == {"start", "delta", "edit", "regenerate"}
    long = "very <|end|> long \\ text " * 40_000
    out = chat.format_log(chat.events_of(spark.createDataFrame([(1, 0, "assistant", long, "x")], "conv_id long, turn long, role string, text string, seq string"))).first()
    assert chat.parse(out["formatted"]) == [("assistant", long)] and chat.unescape(out["formatted"][out["loss_begin"][0] : out["loss_end"][0]]) == long


def test_chat_repeated_rows(spark):
    rows = [(1, 0, "user", "a<|end|>"), (1, 0, "user", "a<|end|>"), (1, None, None, None), (2, 1, "assistant", "x")]
    out = chat.format_log(chat.events_of(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).collect()
    assert {r["conv_id"]: len(chat.parse(r["formatted"])) for r in out} == {1: 3, 2: 1}
    assert chat.format_log(spark.createDataFrame([], chat.EVENTS)).count() == 0


# 8


def test_suffix_array():
    rng = np.random.default_rng(1)
    for _ in range(150):
        letters, k, depth = rng.integers(1, 4), int(rng.integers(1, 6)), int(rng.integers(3, 20))
        raw = [rng.integers(97, 97 + letters, int(rng.integers(depth, 60))).astype(np.uint8) for _ in range(k)]
        if k > 1:
            raw[1] = np.concatenate([raw[0][3:], raw[1]])
        size = np.array([len(r) for r in raw])
        end, text = np.cumsum(size), np.concatenate(raw)
        count = np.array([int(rng.integers(1, s - depth + 2)) for s in size])
        order = suffix.suffix_array(text, end - size, count, end, depth)
        of = np.repeat(np.arange(k), size)[order]
        order = order[order - (end - size)[of] < count[of]]
        strings = [text[i : i + depth].tobytes() for i in order]
        assert len(set(order.tolist())) == len(order) == count.sum() and strings == sorted(strings)
        assert suffix.equal_strings(text, order, depth).tolist() == [False] + [a == b for a, b in zip(strings, strings[1:])]


def brute_bytes(rows, length=100):
    seen, out = {}, {}
    for i, t in sorted(rows):
        raw = (t or "").encode()
        gone = bytearray(len(raw))
        for a in range(len(raw) - length + 1):
            if seen.setdefault(raw[a : a + length], (i, a)) != (i, a):
                gone[a : a + length] = b"\1" * length
        kept = bytes(x for x, g in zip(raw, gone) if not g)
        out[i] = (len(raw), sum(gone), sum(g and not (a and gone[a - 1]) for a, g in enumerate(gone)), kept)
    return out


def test_suffix_dedup(corpus, docs, empty):
    got = suffix.suffix_dedup(docs).collect()
    want = brute_bytes(corpus)
    assert len(got) == docs.count() and suffix.suffix_dedup(empty).count() == 0
    for r in got:
        own = (r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"]))
        assert own == (want[r["doc_id"]] if r["doc_id"] is not None else (len((r["text"] or "").encode()), 0, 0, (r["text"] or "").encode()))


def test_suffix_hot_anchors(spark, corpus, docs, monkeypatch):
    """Strings of anchors with many contexts are dealt by their own bytes: no task gets all contexts of an anchor."""
    rng = random.Random(8)
    phrase, passage = "q" + prose(rng, 8)[:50].replace("\n", " "), prose(rng, 30)
    rows = [(i, prose(rng, 30) + " " + (phrase if i % 2 else passage) + " " + prose(rng, 30)) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for name, value in (("SAMPLE", 1), ("HOT", 5)):
        monkeypatch.setattr(suffix, name, value)
    made, real = [], suffix._lost
    monkeypatch.setattr(suffix, "_lost", lambda contexts, length: made.append(contexts) or real(contexts, length))
    want = brute_bytes(rows)
    for r in suffix.suffix_dedup(df).collect():
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) == want[r["doc_id"]]
    assert sum(w[1] for w in want.values()) > 100 * 29
    most = made[0].where("context is not null").groupBy("g").agg(F.countDistinct("context").alias("c")).agg(F.max("c")).first()[0]
    assert most < 5  # the phrase alone has 30
    monkeypatch.setattr(suffix, "HOT", 1)  # all strings one by one
    want = brute_bytes(corpus)
    for r in suffix.suffix_dedup(docs).where("doc_id is not null").collect():
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) == want[r["doc_id"]]


# 9


def brute_words(rows, k=13):
    first, out = {}, {}
    for i, t in sorted(rows):
        w = ascii_words(t)
        gone = set()
        for a in range(len(w) - k + 1):
            if first.setdefault(tuple(w[a : a + k]), i) < i:
                gone.update(range(a, a + k))
        out[i] = (len(w), len(gone), [x.decode() for j, x in enumerate(w) if j not in gone])
    return out


@pytest.mark.parametrize("bits", [28, 4])
def test_substring_dedup(corpus, docs, empty, monkeypatch, bits):
    monkeypatch.setattr("fuzzcurve.llm.sketch.MOST_BITS", bits)  # 4: the sketch is full and passes everything
    if bits == 4:
        monkeypatch.setattr("fuzzcurve.llm.sketch.bits_for", lambda n: 4)
        monkeypatch.setattr(substring, "HELD", 50)
    got = substring.substring_dedup(docs).collect()
    want = brute_words(corpus)
    assert len(got) == docs.count() and substring.substring_dedup(empty).count() == 0
    for r in got:
        words = [x.decode() for x in ascii_words(r["text"])]
        if r["doc_id"] is not None:
            assert (r["n_words"], r["n_removed"], words) == want[r["doc_id"]]
        else:
            assert r["n_removed"] == 0


# all


def test_counts_of_rows_and_empty_tables(spark, docs, empty):
    assert quality.quality_report(docs).count() == docs.count() and quality.quality_report(empty).count() == 0
    assert quality.quality_filter(docs).columns == docs.columns and quality.quality_filter(empty).count() == 0
    assert jaccard.jaccard_components(empty).count() == 0
    assert bpe.encode(empty).count() == 0 and packing.pack(empty).count() == 0
    pages = spark.createDataFrame([], "page_id long, url string")
    assert urls.url_verdicts(pages, urls.rule_table(spark)).count() == 0


def brute_failed(text):
    """The base rules: fewer than 50 words, or over half of them in 3-word windows that the text has twice."""
    from collections import Counter

    w = ascii_words(text)
    windows = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    again = {i + j for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for j in range(3)}
    return len(w) < 50 or 100 * len(again) > 50 * len(w)


def test_pipeline_stages(spark, docs, empty, tmp_path, tiktoken_encode):
    import corpus_pipeline as p
    from fuzzcurve.llm.common import write_table

    bench = spark.createDataFrame([(0, " ".join(docs.where("doc_id = 20").first()["text"].split()[10:40]))], "item_id long, text string")
    bench.write.parquet(str(tmp_path / "benchmark.parquet"))
    at = docs
    for k, (name, stage) in enumerate(p.STAGES):
        before = at.collect()
        at = write_table(stage(spark, at, str(tmp_path)), "test")
        rows = at.collect()
        if k < 4:
            assert at.columns == docs.columns
        ids = {r["doc_id"] for r in rows}
        by = {r["doc_id"]: r["text"] for r in before}
        if k == 0:
            assert ids - {None} == {i for i, t in by.items() if i is not None and not brute_failed(t)}
            assert all(by[r["doc_id"]] == r["text"] for r in rows if r["doc_id"] is not None)  # no line is in twenty documents
        elif k == 1:
            assert ids - {None} == {c for i, (_, c) in brute_components([(i, t) for i, t in by.items() if i is not None]).items()}
        elif k == 2:
            want = brute_words([(i, t) for i, t in by.items() if i is not None])
            assert all([x.decode() for x in ascii_words(r["text"])] == want[r["doc_id"]][2] for r in rows if r["doc_id"] is not None)
        elif k == 3:
            found = brute_contamination([(i, t) for i, t in by.items() if i is not None], [tuple(r) for r in bench.collect()])
            assert {r["doc_id"] for r in before} - ids == {i for i, items in found.items() if items} == {20}
        else:
            assert all(np.frombuffer(r["ids"], "<u4").tolist() == tiktoken_encode(by[r["doc_id"]] or "") for r in rows if r["doc_id"] is not None)
    at = empty
    for _, stage in p.STAGES:
        at = write_table(stage(spark, at, str(tmp_path)), "test")
        assert at.count() == 0
