"""Plain Python versions of what the document operators compute, and awkward rows."""

import re
from collections import Counter, defaultdict

from pyspark.sql import types as T

WORD = re.compile(r"[^\x20\x09-\x0D]+")
PROSE = "The quick brown fox jumps over the lazy dog near a quiet river while seven old ships drift slowly past the harbour wall"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that the operators use for columns of their own.
CLASHING = ("rep", "cluster", "size", "shard", "score", "words", "row", "node", "component", "label", "_words", "spans", "part", "text_key", "cell")


def awkward(spark):
    """Nulls, empty, blank, short and very long texts, repeated rows, equal texts, and clashing extra columns."""
    long_text = " ".join(f"{PROSE} {i}." for i in range(4000))
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, "one two"), (5, long_text), (5, long_text), (6, PROSE), (7, PROSE), (None, PROSE), (None, None), (8, "é " * 60 + "日本 🙂")]
    schema = T.StructType([*T._parse_datatype_string(DOCS).fields, *[T.StructField(c, T.StringType()) for c in CLASHING]])
    return spark.createDataFrame([(i, t, None, "s", None if t is None else len(t), *["x"] * len(CLASHING)) for i, t in rows], schema)


def empty(spark):
    return spark.createDataFrame([], DOCS)


def shingles(text, size=5):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))} if words else set()


def components(sets, percent):
    """Smallest linked id of every id, by comparing all pairs that share anything."""
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    holders = defaultdict(list)
    for i, s in sets.items():
        for v in s:
            holders[v].append(i)
    for i, s in sets.items():
        for j, both in Counter(j for v in s for j in holders[v] if j > i).items():
            if 100 * both >= percent * (len(s) + len(sets[j]) - both):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in sets}


def line_counts(text):
    text = text or ""
    w = WORD.findall(text)
    seen, covered = Counter(zip(w, w[1:], w[2:])), set()
    for i in range(len(w) - 2):
        if seen[tuple(w[i : i + 3])] > 1:
            covered |= {i, i + 1, i + 2}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), failed


def benchmark_hits(text, items, window=13):
    """n_words, hit word positions, items found."""
    def words(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))

    w, hit, found = words(text), set(), set()
    for name, item in items:
        v = words(item)
        n = min(window, len(v))
        keys = {tuple(v[i : i + n]) for i in range(len(v) - n + 1)} if n else set()
        for i in range(len(w) - n + 1):
            if n and tuple(w[i : i + n]) in keys:
                hit |= set(range(i, i + n))
                found.add(name)
    return len(w), hit, found


SECRET = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def base_secrets(text):
    text = text or ""
    found = [(m.start(), 0, m.end(), "assign") for m in SECRET.finditer(text) if len(m[2]) >= 8]
    found += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    found += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return [(k, a, b) for a, _, b, k in sorted(found)]
