"""Merkle manifest, chat format and periodic runs against plain Python and SQL."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import oracle
from arcloom.llm import chat, merkle, periodic_runs, tasks
from odd_rows import ODD, SF


@pytest.mark.parametrize("name, count", [("op11_merkle_manifest", 200), ("op12_chat_format", 21), ("op13_periodic_runs", 200)])
def test_query_matches_sql(spark, name, count):
    took, rows, problem = oracle.compare(spark, oracle.connect(SF), name, SF, entry.queries(), entry.oracle_sql())
    assert problem is None and rows == count


# periodic runs

def brute_runs(words, least):
    found = {}
    for q in range(1, len(words) // 2 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(2 * q, least):
                found.setdefault((i, j + q), q)
            i = max(j, i + 1)
    return sorted((s, e - s, q) for (s, e), q in found.items())


def a_text(rnd, longest):
    words = [rnd.choice("abcd"[:rnd.choice([1, 2, 3, 4])]) for _ in range(rnd.randrange(longest))]
    if words and rnd.random() < 0.5:
        a = rnd.randrange(len(words))
        p = 1 + rnd.randrange(1 + (len(words) - a) // 2)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    return words


def hashes(words):
    return tasks.mix(np.array([ord(w) for w in words], np.uint64) * np.uint64(977) + np.uint64(5))


def test_catchers_find_all_runs_however_words_arrive():
    rnd = random.Random(3)
    for _ in range(150):
        words, least = a_text(rnd, 90), rnd.choice([2, 3, 12])
        want = brute_runs(words, least)
        for step in (1, rnd.randrange(2, 9), 200):
            catchers = periodic_runs.SquareCatchers(least)
            for i in range(0, len(words), step):
                catchers.append(hashes(words[i:i + step]))
            assert list(map(tuple, catchers.runs().T.tolist())) == want


def test_runs_are_reported_while_the_text_grows():
    catchers = periodic_runs.SquareCatchers(4)
    seen = []
    for w in "xababacx":
        catchers.append(hashes(w))
        seen.append(list(map(tuple, catchers.runs().T.tolist())))
    assert seen[3:] == [[], [(1, 4, 2)], [(1, 5, 2)], [(1, 5, 2)], [(1, 5, 2)]]


def test_runs_and_collapsed_texts(spark):
    rnd = random.Random(8)
    texts = {i: " ".join(a_text(rnd, 120)) for i in range(300)}
    # a period of many words, and one text beyond a chunk of bytes
    texts[300] = " ".join(str(i % 3000) for i in range(20_000))
    texts[301] = " ".join(str(i % 70_001) for i in range(250_000))
    df = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string").repartition(5)
    rows = {r["doc_id"]: r for r in periodic_runs.find_runs(df, collapsed_sha256="digest").collect()}
    assert rows.keys() == texts.keys()
    for i, text in texts.items():
        words = text.split()
        want = brute_runs(words, 12) if i < 300 else [(0, len(words), 3000 if i == 300 else 70_001)]
        assert [tuple(x) for x in rows[i]["runs"]] == want
        gone = {k for s, n, q in want for k in range(s + q, s + n)}
        kept = " ".join(w for k, w in enumerate(words) if k not in gone)
        assert rows[i]["collapsed"] == kept and rows[i]["digest"] == hashlib.sha256(kept.encode()).hexdigest()


def test_runs_of_odd_rows(spark, odd, nothing):
    rows = periodic_runs.find_runs(odd).collect()
    assert Counter((r["doc_id"], r["text"], r["size"]) for r in rows) == Counter((i, t, 7) for i, t, *_ in ODD)
    for r in rows:
        repeats = (r["text"] or "").startswith("long ")
        assert [tuple(x) for x in r["runs"]] == ([(0, 30_000, 1)] if repeats else [])
        assert r["collapsed"] == ("long" if repeats else " ".join((r["text"] or "").split()))
    assert periodic_runs.find_runs(nothing).count() == 0
    with pytest.raises(ValueError, match="size"):
        periodic_runs.find_runs(odd, runs="SIZE")


# chat format

HARD = ["", "plain", "\\", "\\s", "\\p", "<|", "<\\p|", "<\\|", "<<||>", "<|end|>", "a<", "|end|>", "\\### Assistant: </turn> ok",
        "line\nline", "<|start|>assistant<|text|>gotcha<|end|>", "été \U0001f600 <|part|>", "\\\\<|\\<|", "x" * 100_000]


def test_chats_read_back_and_merge(spark):
    rnd = random.Random(5)
    turns = [(c, t, rnd.choice(["user", "assistant", "system", "<|odd|>"]), rnd.choice(HARD))
             for c in range(40) for t in range(rnd.randrange(1, 9))]
    turns += [(99, t, "user" if t % 3 else "assistant", f"turn {t}") for t in range(5_000)]  # one long conversation
    df = spark.createDataFrame(turns, "conv_id bigint, turn int, role string, text string").repartition(6)
    rows = chat.format_chats(df).select("*", chat.read_turns(F.col("formatted")).alias("back"),
                                        chat.loss_text(F.col("segments")).alias("loss")).collect()
    want = defaultdict(list)
    for c, t, role, text in sorted(turns):
        want[c].append((role, text))
    assert {r["conv_id"] for r in rows} == set(want)
    for r in rows:
        mine = want[r["conv_id"]]
        assert [tuple(x) for x in r["back"]] == mine
        assert r["loss"] == "".join(x for role, x in mine if role == "assistant")
        assert "".join(s["text"] for s in r["segments"]) == r["formatted"]
        messages = 1 + sum(a[0] != b[0] for a, b in zip(mine, mine[1:]))
        assert r["formatted"].count(chat.START) == r["formatted"].count(chat.END) == messages
        assert r["formatted"].count(chat.PART) == len(mine) - messages


def test_formatted_chat_looks_like_this(spark):
    df = spark.createDataFrame([(1, 2, "assistant", "yes"), (1, 0, "user", "a"), (1, 1, "user", "b <|"), (1, 3, "user", None)],
                               "conv_id int, turn int, role string, text string")
    row = chat.format_chats(df).first()
    assert row["formatted"] == ("<|start|>user<|text|>a<|part|>b <\\p|<|end|><|start|>assistant<|text|>yes<|end|>"
                                "<|start|>user<|text|><|end|>")
    assert [s["text"] for s in row["segments"] if s["loss"]] == ["yes"]


def test_chats_of_odd_rows(spark, odd, nothing):
    rows = [(None, None, None, None), (None, 0, "user", "a"), (1, None, "assistant", "b"), (1, None, "assistant", "b"),
            (1, 1, None, "c"), (1, 1, "assistant", ""), (2, 0, "assistant", None)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows],
                               "conv_id bigint, turn int, role string, text string, formatted string, segments int")
    out = {r["conv_id"]: [tuple(x) for x in r["back"]] for r in chat.format_chats(df).select(
        "conv_id", chat.read_turns(F.col("formatted")).alias("back")).collect()}
    assert out == {None: [("", ""), ("user", "a")], 2: [("assistant", "")],
                   1: [("assistant", "b"), ("assistant", "b"), ("", "c"), ("assistant", "")]}
    assert chat.format_chats(df.filter("false")).count() == 0
    assert chat.format_chats(odd, "doc_id", "size", "source", "text").count() == len({i for i, *_ in ODD})


def test_chat_plan_has_no_python(spark):
    plan = entry.queries()["op12_chat_format"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


# Merkle manifest

def sha(*x):
    return hashlib.sha256("".join(x).encode()).hexdigest()


def plain_leaf(*values):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def plain_tree(leaves):
    """(root, siblings and sides of each leaf)."""
    paths, at, level = [([], []) for _ in leaves], list(range(len(leaves))), leaves
    while len(level) > 1:
        for path, i in zip(paths, at):
            if i ^ 1 < len(level):
                path[0].append(level[i ^ 1])
            path[1].append(0 if i ^ 1 >= len(level) else -1 if i % 2 else 1)
        at = [i // 2 for i in at]
        level = [sha(*level[i:i + 2]) for i in range(0, len(level), 2)]
    return level[0], paths


def plain_manifest(rows):
    """rows of (id, group, leaf) → Counter of (id, leaf, subroot, root, proof, sides)."""
    groups = defaultdict(list)
    for i, g, leaf in rows:
        groups[g].append((i is not None, i, leaf))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: plain_tree([x[2] for x in sorted(groups[g], key=lambda x: (x[0], x[1] or 0, x[2]))]) for g in names}
    root, tops = plain_tree([trees[g][0] for g in names])
    out = Counter()
    for g, top in zip(names, tops):
        for (_, i, leaf), path in zip(sorted(groups[g], key=lambda x: (x[0], x[1] or 0, x[2])), trees[g][1]):
            out[(i, leaf, trees[g][0], root, tuple(path[0] + top[0]), tuple(path[1] + top[1]))] += 1
    return out


def found_manifest(df):
    return Counter((r["doc_id"], r["leaf"], r["subroot"], r["root"], tuple(r["proof"]), tuple(r["sides"])) for r in df.collect())


@pytest.mark.parametrize("sizes", [[1], [5, 1, 9, 3], [70, 1, 17] + [1] * 9])
def test_manifest_of_any_shape(spark, sizes):
    rows = [(1000 * k + i, f"g{k}", f"text {i}") for k, n in enumerate(sizes) for i in range(n)]
    df = spark.createDataFrame(rows, "doc_id bigint, lang string, text string").repartition(4)
    found = merkle.manifest(df, ["doc_id", "lang", "text"], "lang", "doc_id", super_levels=2)
    out = found.collect()
    assert found_manifest(found) == plain_manifest([(i, g, plain_leaf(i, g, t)) for i, g, t in rows])
    assert all(r["verified"] and r["folded_root"] == r["root"] for r in out)
    assert all(merkle.fold(r["leaf"], r["proof"], r["sides"]) == r["root"] for r in out)


def test_manifest_shows_changed_rows(spark):
    rows = [(i, "a" if i % 3 else None, i % 5) for i in range(50)]
    df = spark.createDataFrame(rows, "doc_id bigint, lang string, n int")
    out = merkle.manifest(df, ["doc_id", "n"], "lang", "doc_id", {"n": F.when(F.col("doc_id") % 7 == 0, 77).otherwise(F.col("n"))}, 3).collect()
    assert {r["doc_id"] for r in out if not r["verified"]} == set(range(0, 50, 7))
    for r in out:
        n = 77 if r["doc_id"] % 7 == 0 else r["doc_id"] % 5
        assert r["folded_root"] == merkle.fold(plain_leaf(r["doc_id"], n), r["proof"], r["sides"])


def test_manifest_of_odd_rows(spark, odd, nothing):
    found = merkle.manifest(odd, ["doc_id", "source", "text"], "lang", "doc_id", super_levels=1)
    assert found_manifest(found) == plain_manifest([(i, g, plain_leaf(i, s, t)) for i, t, g, s in ODD])
    assert merkle.manifest(nothing, ["doc_id", "text"], "lang", "doc_id").count() == 0
