"""Line rules, sharding and quotation links: DataFrame operations only."""

import hashlib
import random
import zlib

import pytest

from curvelake.llm import line_rules, quotes, sharding
from helpers import PROSE, awkward, empty, line_counts

SF = "/root/testdata/sf0.001"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def is_native(df):
    plan = df._jdf.queryExecution().toString()
    return not any(x in plan for x in ("Python", "Pandas", "Arrow"))


def test_line_counts(spark):
    rows = [(1, "a a a a b"), (2, "x y z\nx y z\n\n x y z"), (3, "p q r p q r p"), (4, "a\tb\x0bc d"), (5, None)]
    small = spark.createDataFrame(rows, "doc_id long, text string")
    for docs in (small, awkward(spark), spark.read.parquet(f"{SF}/documents.parquet")):
        found = line_rules.clean_lines(docs)
        assert is_native(found)
        key = lambda r: (str(r[0]), r[1:])
        got = sorted(((r.doc_id, *[r[c] for c in COUNTS]) for r in found.collect()), key=key)
        assert got == sorted(((r.doc_id, *line_counts(r.text)) for r in docs.collect()), key=key)
    assert line_rules.clean_lines(empty(spark)).count() == 0


def test_line_verdicts(spark):
    good = "\n".join(" ".join(f"{w}{i}" for w in PROSE.split()) + "." for i in range(5))
    rows = [
        (1, good), (2, good + "\nHome | News | Sport | Shop\nThis work is licensed under CC BY-NC 4.0.\nRead more"),
        (3, good + "\n" + "\n".join(f"w{i}### v{i}%%% u{i}$$$ t{i}&&&" for i in range(60))), (4, "\n".join(f"W{i}!! X{i}!! Y{i}!!" for i in range(40))),
    ]
    got = {r.doc_id: r for r in line_rules.clean_lines(spark.createDataFrame(rows, "doc_id long, text string"), carry=True).collect()}
    assert [got[i].kept for i in (1, 2, 3, 4)] == [True, True, False, False]
    assert got[2].cleaned_text == got[1].cleaned_text == good and got[2].row.text.endswith("Read more")


def test_clean_documents_stay(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    seen = line_rules.clean_lines(docs).join(labels, "doc_id").filter("NOT base_failed").groupBy("quality").agg({"*": "count", "kept": "max"}).collect()
    rows = line_rules.clean_lines(docs).join(labels, "doc_id").filter("NOT base_failed").select("quality", "kept").collect()
    assert seen and all(r.kept == (r.quality == 1) for r in rows)


def smallest_capacity(sizes, shards):
    def used(capacity):
        n, fill = 1, 0
        for s in sizes:
            n, fill = (n + 1, s) if fill + s > capacity else (n, fill + s)
        return n

    low, high = max(sizes), sum(sizes)
    while low < high:
        middle = (low + high) // 2
        low, high = (low, middle) if used(middle) <= shards else (middle + 1, high)
    return low


@pytest.mark.parametrize("hot", [0, 400])
def test_sharding(spark, hot):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    if hot:
        docs = docs.unionByName(spark.range(10_000, 10_000 + hot).selectExpr("id AS doc_id", f"repeat('{PROSE} ', 40) AS text"))
    placed = sharding.shard_documents(docs)
    assert is_native(placed)
    text, rows, atoms, of = {r.doc_id: r.text for r in docs.collect()}, placed.collect(), {}, {}
    for r in rows:
        raw = (text[r.doc_id] or "").encode()
        assert r.size == len(raw) + 1 and r.text_crc32 == zlib.crc32(raw)
        atom = hashlib.md5(raw).hexdigest()[:4]
        atoms[atom] = atoms.get(atom, 0) + r.size
        assert of.setdefault(atom, r.shard) == r.shard
    order = sorted(atoms)
    assert [of[a] for a in order] == sorted(of.values()) and max(of.values()) <= 15
    totals = {}
    for a in order:
        totals[of[a]] = totals.get(of[a], 0) + atoms[a]
    assert max(totals.values()) == smallest_capacity([atoms[a] for a in order], 16)
    slots = {}
    for r in rows:
        slots.setdefault(r.shard, []).append(r.slot)
    assert len(rows) == len(text) and all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_sharding_awkward_rows(spark):
    rows = sharding.shard_documents(awkward(spark)).collect()
    assert len(rows) == 11 and {r["size"] for r in rows if r.doc_id in (1, 2)} == {1}
    assert len({r.shard for r in rows if r.doc_id in (6, 7)}) == 1
    assert sharding.shard_documents(empty(spark)).count() == 0


CHAT = "conv_id long, turn long, role string, text string"


def linked(spark, rows):
    out = quotes.link_quotations(spark.createDataFrame(rows, CHAT))
    assert is_native(out)
    return sorted(out.collect(), key=lambda r: (r.conv_id is None, r.conv_id or 0, r.path))


def test_quotation_links(spark):
    rows = [
        (1, 0, "a", "The plan is ready.\nShall we   start today?"),
        (1, 1, "b", "I like the plan.\nBut not today."),
        (1, 2, "c", "Fine with me."),
        (1, 3, "d", "> shall we START today?\nNo, tomorrow."),
        (1, 4, "e", "> > Shall we start today?\n> No, tomorrow.\nWhy not?"),
        (1, 5, "f", "> Never said by anyone.\nHm."),
        (1, 6, "g", "> The plan is ready.\n> Shall we start today?\nYes."),
        (2, 0, "a", "> The plan is ready.\nOther place."),
    ]
    got = linked(spark, rows)
    one = {r.turn: r for r in got if r.conv_id == 1}
    assert {t: r.reply_to for t, r in one.items()} == {0: None, 1: 0, 2: 1, 3: 0, 4: 3, 5: 4, 6: 0}
    assert [r.turn for r in got if r.conv_id == 1] == [0, 1, 2, 3, 4, 5, 6]
    assert (one[4].n_quotes, one[4].n_linked, one[4].text) == (2, 2, "Why not?") and one[3].text == "No, tomorrow."
    assert (one[5].n_quotes, one[5].n_linked) == (1, 0) and (one[6].n_quotes, one[6].n_linked) == (1, 1)
    assert one[0].text.startswith("The plan is ready.\nShall we   start")
    other = [r for r in got if r.conv_id == 2]
    assert other[0].n_linked == 0 and other[0].reply_to is None


def preorder(parent):
    children, out = {}, []
    for t in sorted(parent):
        children.setdefault(parent[t], []).append(t)
    stack = [None]
    while stack:
        t = stack.pop()
        out += [] if t is None else [t]
        stack += reversed(children.get(t, []))
    return out


@pytest.mark.parametrize("cell", [4096, 5])
def test_reply_order_of_random_conversations(spark, monkeypatch, cell):
    monkeypatch.setattr(quotes, "TURN_CELL", cell)
    draw, rows, parents = random.Random(cell), [], {}
    for conv in range(12):
        parent = {}
        for turn in range(draw.randint(1, 40)):
            target = draw.randrange(turn) if turn and draw.random() < 0.3 else None
            own = f"message {conv} {turn} says this"
            rows.append((conv, turn, "x", own if target is None else f"> message {conv} {target} says this\n{own}"))
            parent[turn] = target if target is not None else (turn - 1 if turn else None)
        parents[conv] = parent
    got = linked(spark, rows)
    for conv, parent in parents.items():
        mine = [r for r in got if r.conv_id == conv]
        assert {r.turn: r.reply_to for r in mine} == parent
        assert [r.turn for r in mine] == preorder(parent)


def test_quotation_awkward_rows(spark):
    rows = [(None, 0, "a", "x"), (None, None, None, None), (3, 0, "a", None), (3, 1, "b", ""), (3, 1, "b", ""), (3, None, "c", "> x"), (3, 2, "d", "> y\n>\n> > z")]
    got = linked(spark, rows)
    assert len(got) == 7 and [(r.turn, r.copy) for r in got if r.conv_id == 3 and r.turn is not None] == [(0, 0), (1, 0), (1, 1), (2, 0)]
    assert [r.n_quotes for r in got if r.turn == 2] == [2] and linked(spark, []) == []
