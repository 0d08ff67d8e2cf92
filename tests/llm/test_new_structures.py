"""Language identification, periodic runs and the prefix trie against plain versions."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from curvelake.llm import language_id, periodic_runs, prefix_trie
from curvelake.llm.queries import REGISTRY, repeated_tails
from helpers import WORD, awkward, empty

SF = "/root/testdata/sf0.001"
ES = "El perro corre por la calle y la gente mira desde el balcón mientras cae la tarde sobre los tejados de la ciudad"
EN = "The dog runs down the street and the people watch from the balcony while the evening falls over the roofs of the town"


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_the_root_holds_every_conversation(spark):
    conversations = spark.read.parquet(f"{SF}/conversations.parquet")
    [root] = REGISTRY["op13_prefix_trie"].build(spark, SF).filter("depth = 0").collect()
    assert root.n_convs == conversations.select("conv_id").distinct().count()


# Language identification


def plain_letters(text):
    return " ".join(re.findall(r"[^\W\d_]+", (text or "").lower()))


def test_dictionaries_count_whole_texts(spark):
    """Units by frequency over whole texts, learnt only from the rows that may be."""
    rows = [(i, f"{ES} único{i}." if i % 2 else f"{EN} single{i}!", "es" if i % 2 else "en") for i in range(120)] + [(500, "nunca", None), (None, "nadie " * 9, "es")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    learnt = {lang: (n, content.decode()) for lang, n, content in language_id.dictionaries(docs)}
    for lang in ("es", "en"):
        usable = [t for i, t, found in rows if found == lang and i is not None and zlib.crc32(str(i).encode()) % 3 != 1]
        words = [plain_letters(t).split() for t in usable]
        units = Counter(w for ws in words for w in ws) + Counter(f"{a} {b}" for ws in words for a, b in zip(ws, ws[1:]))
        order = sorted(units, key=lambda u: (-units[u], u))
        assert learnt[lang] == (len(usable), " ".join(reversed(order)))


def test_small_dictionaries_keep_the_commonest(spark):
    rows = [(i, " ".join(["uno"] * 9 + ["dos"] * 5 + ["tres"]), "es") for i in range(30)]
    [(lang, _, content)] = language_id.dictionaries(spark.createDataFrame(rows, "doc_id long, text string, lang string"), size=24)
    assert lang == "es" and content.decode().split(" ")[-1] == "uno" and len(content) <= 24


def test_languages_against_plain_scores(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    learnt = language_id.dictionaries(docs)
    names, encoders = [x[0] for x in learnt], [language_id.encoder(x[2]) for x in learnt]
    text = {r.doc_id: r.text for r in docs.collect()}
    for r in language_id.identify(docs, learnt).collect():
        raw = plain_letters(text[r.doc_id]).encode()
        size = [sum(len(e.compress(raw[i : i + 1024])) for i in range(0, len(raw), 1024)) for e in encoders]
        best = size.index(min(size))
        assert (r.lang_pred, r.held_out) == (names[best], zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
        second = sorted(size)[1]
        assert r.margin == second - size[best] and r.rejected == (r.margin < 2 or r.margin < 0.02 * second)
        assert r.score == pytest.approx(1 / sum(2.0 ** (size[best] - s) for s in size))


def test_held_out_languages(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = language_id.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert sum(r.lang_pred == r.lang for r in found) >= 0.98 * len(found) > 300
    wrong = [r for r in found if not r.rejected and r.lang_pred != r.lang]
    assert len(wrong) <= 0.01 * len(found) and sum(r.rejected for r in found) <= 0.05 * len(found)


def test_awkward_languages(spark):
    learnt = [("en", 5, EN.lower().encode()), ("es", 3, ES.lower().encode())]
    got = {(r.doc_id, r.lang_pred): r for r in language_id.identify(awkward(spark), learnt).collect()}
    assert language_id.identify(awkward(spark), learnt).count() == 11
    for doc_id in (1, 2, 3):
        r = got[doc_id, "und"]
        assert r.score == 0 and r.margin is None and r.rejected
    # A tie goes to the language with more rows, and is no certain one.
    assert got[4, "en"].score == 0.5 and got[4, "en"].rejected
    assert language_id.identify(empty(spark), learnt).count() == 0 and language_id.identify(empty(spark)).count() == 0
    nothing = language_id.identify(awkward(spark)).collect()
    assert {r.lang_pred for r in nothing} == {"und"}
    other = spark.createDataFrame([(1, "12345 ... 🙂"), (2, ES + " " + ES), (3, EN.upper())], "doc_id long, text string")
    assert [r.lang_pred for r in language_id.identify(other, learnt).orderBy("doc_id").collect()] == ["und", "es", "en"]
    alone = language_id.identify(other, learnt[:1]).orderBy("doc_id").collect()
    assert [(r.lang_pred, r.margin, r.rejected) for r in alone[1:]] == [("en", None, False)] * 2


# Periodic runs


def plain_runs(words, least=6, times=4):
    found = {}
    for q in range(1, len(words) // times + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j > i and j - i + q >= max(least, times * q):
                found.setdefault((i, j - i + q), q)
            i = max(i, j) + 1
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def test_runs_of_random_texts():
    r = random.Random(11)
    for _ in range(400):
        texts = []
        for _ in range(r.randint(1, 5)):
            letters, words = "abcdefgh"[: r.choice([1, 2, 3, 5])], []
            for _ in range(r.randint(0, 8)):
                words += ([r.choice(letters) for _ in range(r.randint(1, 6))] * r.randint(1, 9))[: r.randint(1, 40)]
            texts.append(words)
        least, times = r.choice([(6, 4), (6, 4), (2, 3), (9, 3), (10, 5)])
        assert periodic_runs.runs_of(texts, least, times) == [plain_runs(w, least, times) for w in texts]


def test_runs_in_long_texts():
    n = 30_000
    phrase = [w for i in range(n // 7) for w in ("a", "b", "c", "d", "e", "f", str(i))]
    many = [w for i in range(n // 9) for w in (*["a"] * 8, str(i))]
    same, cycle, none, small = periodic_runs.runs_of([["x"] * n, [str(i % 777) for i in range(n)], phrase, many], 6, 4)
    assert same == [(0, n, 1)] and cycle == [(0, n, 777)] and none == []
    assert small == [(9 * i, 8, 1) for i in range(n // 9)]


def test_collapsed_words(spark):
    rows = [(1, "a b a b a b a b c"), (2, "x x x x x x y y y y y y"), (3, "p p p p p"), (4, "k l m k l m k l m k l m k")]
    got = {r.doc_id: ([tuple(x) for x in r.runs], r.collapsed) for r in periodic_runs.periodic_runs(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {
        1: ([(0, 8, 2)], "a b c"), 2: ([(0, 6, 1), (6, 6, 1)], "x y"), 3: ([], "p p p p p"), 4: ([(0, 13, 3)], "k l m"),
    }
    with pytest.raises(ValueError):
        periodic_runs.periodic_runs(spark.createDataFrame(rows, "doc_id long, text string"), min_repeats=2)


def plain_tail(doc_id, words):
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not words:
        return words
    g = h // 10
    a = g % len(words)
    p = 1 + (len(words) - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, len(words))]


def test_awkward_runs(spark):
    docs = awkward(spark).unionByName(awkward(spark).selectExpr("doc_id + 20 AS doc_id", "* EXCEPT (doc_id)"))
    rows = {r.doc_id: r for r in periodic_runs.periodic_runs(repeated_tails(docs)).collect()}
    want = {r.doc_id: plain_tail(r.doc_id, WORD.findall(r.text or "")) for r in docs.filter("doc_id IS NOT NULL").collect()}
    for doc_id, words in want.items():
        runs = plain_runs(words) if len(words) < 9999 else [tuple(x) for x in rows[doc_id].runs]
        gone = {i for s, n, q in runs for i in range(s + q, s + n)}
        assert [tuple(x) for x in rows[doc_id].runs] == runs and rows[doc_id].n_words == len(words)
        assert rows[doc_id].collapsed == " ".join(w for i, w in enumerate(words) if i not in gone)
    assert periodic_runs.periodic_runs(docs).count() == 22
    assert periodic_runs.periodic_runs(repeated_tails(empty(spark))).count() == 0


# Prefix trie


def plain_trie(rows, rebuild):
    turns = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            turns[c].append((t is not None, t or 0, role or "", text or ""))
    turns = {c: [x[2:] for x in sorted(v)] for c, v in turns.items()}
    whole = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 6 if rebuild else 0
        whole[c] = tuple((turns.get(c - c % 100, []) if h else [])[:h] + own[h:])
    members = defaultdict(list)
    for c, s in whole.items():
        for d in range(len(s) + 1):
            members[s[:d]].append(c)
    out = []
    for key, mine in members.items():
        below = [k for k in members if k[: len(key)] == key]
        out.append((
            min(mine), len(key), min(members[key[:-1]]) if key else None, len(mine), sum(len(k) == len(key) + 1 for k in below),
            sum(not any(len(x) == len(k) + 1 and x[:-1] == k for x in members) for k in below),
            sum((len(members[k]) - 1) * len(k[-1][1]) for k in below if k),
            digest(",".join(str(c) for c in sorted(mine) if whole[c] == key)),
        ))
    return sorted(out, key=str)


CONVERSATIONS = "conv_id long, turn long, role string, text string"


def made_conversations(seed):
    r = random.Random(seed)
    rows = [(c, r.choice([t, t, None, 3]), r.choice(["user", None]), r.choice(["a", "bb", "", None, "é🙂"])) for c in [*range(40), 100, 117, 205, 299] for t in range(r.randint(1, 6))]
    copies = [(1000 + c, t, "user", f"copy {t}") for c in range(30) for t in range(3)]
    return [*rows, *copies, (None, 1, "user", "nobody"), *[(77, t, "user", "long") for t in range(60)]]


@pytest.mark.parametrize("rebuild", [False, True])
def test_trie_of_made_conversations(spark, rebuild):
    for seed in (1, 2):
        rows = made_conversations(seed)
        frame = spark.createDataFrame(rows, CONVERSATIONS).selectExpr("*", "'x' AS depth", "'y' AS pos", "'z' AS name_a", "1 AS n_rows")
        found = prefix_trie.prefix_trie(frame, rebuild=rebuild)
        assert sorted((tuple(x) for x in found.collect()), key=str) == plain_trie(rows, rebuild)


def test_trie_in_ranges(spark, ranges):
    rows = made_conversations(3)
    assert sorted((tuple(x) for x in prefix_trie.prefix_trie(spark.createDataFrame(rows, CONVERSATIONS), rebuild=True).collect()), key=str) == plain_trie(rows, True)


def test_trie_without_conversations(spark):
    assert prefix_trie.prefix_trie(spark.createDataFrame([], CONVERSATIONS), rebuild=True).count() == 0
    assert prefix_trie.prefix_trie(spark.createDataFrame([(None, 1, "a", "b")], CONVERSATIONS)).count() == 0
    [root] = prefix_trie.prefix_trie(spark.createDataFrame([(1, 1, "user", "only")], CONVERSATIONS), rebuild=True).filter("depth = 0").collect()
    assert root.n_convs == 1 and root.parent_conv_id is None


def test_digest_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "PIECE", 7)
    ends = spark.range(100).selectExpr("id % 2 AS k", "id * 13 % 101 AS conv_id")
    got = {r.k: r.ends_sha256 for r in prefix_trie.end_digests(ends, ["k"]).collect()}
    ids = defaultdict(list)
    for i in range(100):
        ids[i % 2].append(i * 13 % 101)
    assert got == {k: digest(",".join(map(str, sorted(v)))) for k, v in ids.items()}
