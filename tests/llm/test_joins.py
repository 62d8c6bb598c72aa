"""Similarity joins against brute force, byte BPE against the plain library, and the pipeline."""

import base64
import hashlib
import itertools
import random
import re
import time
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from arcloom.llm import byte_bpe, components, embed_dedup, jaccard_join, mixing, tasks
from arcloom.llm.ranking import row_numbers
from arcloom.session import cut_lineage, scratch_root
from odd_rows import ODD, SF


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if len(words) < 5:
        return frozenset([tuple(words)] if words else [])
    return frozenset(tuple(words[i:i + 5]) for i in range(len(words) - 4))


def reach(nodes, links):
    root = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            low = min(root[a], root[b])
            for x in (a, b):
                if root[x] != low:
                    root[x], changed = low, True
    return root


def brute(rows):
    """Component of each (id, text), by all pairs."""
    sets = {(i, t): shingles(t) for i, t in rows if i is not None}
    links = [(a, b) for a, b in itertools.combinations(sorted(sets, key=str), 2)
             if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    names = {k: n for n, k in enumerate(sorted(sets, key=lambda k: (k[0], str(k[1]))))}
    root = reach(names.values(), [(names[a], names[b]) for a, b in links])
    back = {n: k for k, n in names.items()}
    return {k: back[root[n]][0] for k, n in names.items()}, {k: len(s) for k, s in sets.items()}


def variants(seed, groups, each, length):
    rng, out = random.Random(seed), []
    for g in range(groups):
        base = [f"w{rng.randrange(3000)}" for _ in range(length)]
        for _ in range(each):
            words = list(base)
            for _ in range(rng.randrange(0, max(1, length // 25))):
                words[rng.randrange(length)] = f"x{rng.randrange(10 ** 6)}"
            out.append(" ".join(words[rng.randrange(0, 6):]))
    passage = " ".join(f"p{i}" for i in range(60))
    out += [f"{' '.join(f'u{rng.randrange(10 ** 6)}' for _ in range(80))} {passage}" for _ in range(20)]
    rng.shuffle(out)
    return list(enumerate(out))


@pytest.mark.parametrize(("block", "leaf"), [(256, 48), (12, 4)])
def test_jaccard_against_all_pairs(spark, monkeypatch, block, leaf):
    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    monkeypatch.setattr(jaccard_join, "LEAF", leaf)
    rows = variants(3, 4, 25, 60)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.components(docs).collect()}
    want, sizes = brute(rows)
    assert got == {i: (sizes[i, t], want[i, t]) for i, t in rows}
    assert len(set(want.values())) < len(rows) - 40


def test_cells_are_exact(monkeypatch):
    monkeypatch.setattr(jaccard_join, "LEAF", 3)
    rng = np.random.default_rng(4)
    for _ in range(30):
        sets = []
        for _ in range(6):
            base = rng.integers(0, 1 << 40, size=rng.integers(1, 40), dtype=np.uint64)
            for _ in range(4):
                one = base.copy()
                one[:rng.integers(0, len(one) // 4 + 1)] = rng.integers(0, 1 << 40)
                sets.append(np.unique(one))
        found = set()
        jaccard_join._join_cell(jaccard_join._Space(sets), np.arange(len(sets)), found)
        want = {(i, j) for i, j in itertools.combinations(range(len(sets)), 2)
                if 100 * len(np.intersect1d(sets[i], sets[j])) >= 75 * len(np.union1d(sets[i], sets[j]))}
        assert found == want
        sizes = np.array([len(s) for s in sets])
        rows = np.repeat(np.arange(len(sets)), sizes)
        may = jaccard_join._may_link(sizes, jaccard_join._signatures(np.concatenate(sets) << np.uint64(24), rows, sizes))
        assert all(may[i] and may[j] for i, j in want)


def test_jaccard_odd_rows(spark, odd, nothing):
    rows = jaccard_join.components(odd).collect()
    want, sizes = brute([r[:2] for r in ODD])
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in rows if r["doc_id"] is not None) == Counter(
        (i, sizes[i, t], want[i, t]) for i, t, *_ in ODD if i is not None)
    assert [r["component_id"] for r in rows if r["doc_id"] is None] == [None]
    assert jaccard_join.components(nothing).count() == 0
    kept = jaccard_join.keep_one(odd)
    assert kept.columns == odd.columns
    left = Counter((r["doc_id"], r["text"]) for r in kept.collect())
    assert left == Counter({k: 1 for k in {r[:2] for r in ODD} - {(6, "ONE two  three four five six seven")}})


def test_words_and_shingles_by_hand():
    texts = ["a b c d e f", "", "  ", "one", "a b c d e f", "é\tñ\nx y z", "b c d e f"]
    raw = [t.encode() for t in texts]
    data, offsets = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])
    words, row, starts, ends = tasks.word_hashes(data, offsets)
    assert [data[a:b].tobytes().decode() for a, b in zip(starts, ends)] == [w for t in texts for w in t.split()]
    assert Counter(row.tolist()) == Counter({0: 6, 3: 1, 4: 6, 5: 5, 6: 5})
    hashed, row = tasks.shingle_hashes(words, row, len(texts), 5)
    by = {r: hashed[row == r].tolist() for r in range(len(texts))}
    assert by[0] == by[4] and len(by[0]) == 2 and by[6] == by[0][1:] and len(by[3]) == 1 and not by[1]


def test_components_of_paths_and_stars(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(200, 200), (300, 301), (301, 300)]
    rng.shuffle(edges)
    got = {r["node"]: r["component"] for r in components.connected_components(
        spark.createDataFrame(edges, "a bigint, b bigint"), "test").collect()}
    want = reach({x for e in edges for x in e}, edges)
    assert got == {n: c for n, c in want.items() if n != 200}


def vectors(seed):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(40, 24))
    out = [base[rng.integers(40)] * rng.uniform(0.1, 9) + rng.normal(size=24) * rng.choice([0.0, 0.05, 0.22, 0.3]) for _ in range(300)]
    return [v.tolist() for v in out] + [base[0].tolist()] * 3


def test_vectors_against_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(embed_dedup, "BLOCK_ROWS", 40)
    data = vectors(1)
    bad = [None, [], [0.0] * 24, [float("nan")] * 24, [1.0] * 23 + [float("inf")], [1.0, None] * 12, [1.0, 2.0]]
    rows = list(enumerate(data + bad)) + [(None, data[0])]
    out = embed_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"))
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in out.collect()}
    unit = np.array(data)
    unit /= np.linalg.norm(unit, axis=1)[:, None]
    link = unit @ unit.T >= 0.95
    np.fill_diagonal(link, False)
    root = reach(range(len(data)), list(zip(*np.nonzero(link))))
    assert link.sum() > 300
    for i in range(len(data)):
        assert got[i] == (int(link[i].sum()), root[i], root[i] == i)
    for i in range(len(data), len(rows) - 1):
        assert got[i] == (0, i, True)
    assert got[None] == (0, None, False)
    assert embed_dedup.near_duplicates(spark.createDataFrame([], "vec_id bigint, embedding array<float>")).count() == 0


def test_quantisation_bounds_hold():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    codes, scale, error = embed_dedup.quantise(x)
    q = scale[:, None] * codes
    slack = error[:, None] * np.linalg.norm(q, axis=1)[None, :] + error[None, :]
    assert (np.abs(x @ x.T - q @ q.T) <= slack + 1e-12).all()


def plain_encoder():
    import public_tokenizers as P
    import tiktoken

    path = P.path("byte_bpe_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={}), path, P.PATTERN


def test_byte_bpe_equals_the_plain_library(spark, odd, nothing):
    plain, path, pattern = plain_encoder()
    rng = random.Random(1)
    texts = [r[1] for r in ODD if r[1] is None or len(r[1]) < 60_000]
    texts += ["".join(rng.choice(k) for _ in range(rng.randrange(80))) for k in ("aab ", "abcé日\U0001f600 \n", "0 1,2'll", " \t\r\n\x85\xa0x")
              for _ in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    coded = byte_bpe.encode(docs, path, pattern, starts="starts", splits="splits")
    rows = byte_bpe.decode(coded, path, pattern, tokens="tokens").collect()
    for r in rows:
        text = r["text"] or ""
        ids = np.frombuffer(r["ids"], "<u4").tolist()
        assert ids == plain.encode_ordinary(text)
        assert r["decoded"].decode() == text == "".join(r["tokens"])
        at, starts = 0, []
        for i in ids:
            starts.append(len(text.encode()[:at].decode(errors="ignore")))
            at += len(plain.decode_single_token_bytes(i))
        assert r["starts"] == starts
    assert any(r["splits"] for r in rows)
    assert byte_bpe.encode(nothing, path, pattern).count() == 0
    with pytest.raises(ValueError):
        byte_bpe.encode(odd.withColumn("IDS", F.lit(1)), path, pattern)


def test_decoding_pieces_of_characters():
    _, path, pattern = plain_encoder()
    codec = byte_bpe.Codec(byte_bpe.read_ranks(path), pattern)
    ids = np.concatenate([codec.encode(["\U0001f6f0"])[0][:-1]])
    assert codec.decode_tokens(ids)[-1].endswith("�")
    assert codec.decode_tokens(np.zeros(0, np.uint32)) == []


def test_frequent_pieces_are_encoded_once(monkeypatch):
    """However many pieces a task meets; and nothing merges across pieces that are encoded together."""
    plain, path, pattern = plain_encoder()
    monkeypatch.setattr(byte_bpe, "CACHE_PIECES", 200)
    codec = byte_bpe.Codec(byte_bpe.read_ranks(path), pattern)
    asked = Counter()
    encode_pieces = codec._encode_pieces
    monkeypatch.setattr(codec, "_encode_pieces", lambda pieces: asked.update(pieces) or encode_pieces(pieces))
    rng = random.Random(3)
    for part in range(40):
        texts = ["the same words of all texts " + " ".join(rng.choice("ab\u00ff\u0200\U0001f600z") * rng.randrange(1, 90) + f"{part}x{i}"
                                                       for i in range(30)) for _ in range(3)] + ["", "\u00ff", "\u0200\u0200"]
        assert [x.tolist() for x in codec.encode(texts)] == [plain.encode_ordinary(t) for t in texts]
    assert len(asked) > 500 and {asked[p] for p in ("the", " same", " words", " texts")} == {1}


def test_byte_bpe_query(spark):
    plain, _, _ = plain_encoder()
    text = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in entry.queries()["op5_byte_bpe"](spark, SF).collect():
        ids = plain.encode_ordinary(text[r["doc_id"]])
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(text[r["doc_id"]].encode()).hexdigest()


def test_jaccard_and_vector_queries(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    want, sizes = brute(docs)
    got = entry.queries()["op1_jaccard_join"](spark, SF).collect()
    assert {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in got} == {(i, sizes[i, t], want[i, t]) for i, t in docs}
    assert entry.queries()["op7_int8_tiles"](spark, SF).count() == 500


def test_pipeline_stages_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = docs.columns
    held = docs
    plain, _, _ = plain_encoder()
    for name, step in corpus_pipeline.STAGES:
        before = held.collect()
        held = cut_lineage(step(spark, held, SF))
        after = held.collect()
        if name != "byte_bpe":
            assert held.columns == names
        if name == "toxicity":
            assert {r["doc_id"] for r in after} <= {r["doc_id"] for r in before}
        if name == "ngram_jaccard_join":
            want, _ = brute([(r["doc_id"], r["text"]) for r in before])
            assert sorted(r["doc_id"] for r in after) == sorted({c for c in want.values()})
        if name == "pii":
            assert len(after) == len(before) and not any("@mail" in r["text"] for r in after)
        if name == "byte_bpe":
            assert all(r["exact"] for r in after) and len(after) == len(before)
            texts = Counter((r["doc_id"], tuple(plain.encode_ordinary(r["text"]))) for r in before)
            assert Counter((r["doc_id"], tuple(np.frombuffer(r["ids"], "<u4").tolist())) for r in after) == texts
    assert held.count() > 0


def test_pipeline_on_odd_rows(spark, odd, nothing):
    docs = odd.select("doc_id", "text", "lang", "source", F.lit(1).cast("bigint").alias("n_chars"))
    for start in (docs, docs.filter("false")):
        held = start
        for _, step in corpus_pipeline.STAGES:
            held = step(spark, held, SF)
        assert held.count() >= (1 if start is docs else 0)


def _left(spark, make):
    """The tables that stay in the scratch folder for the rows of ``make``, by label; and the rows."""
    def labels():
        return {p.name.rpartition("-")[::2] for p in Path(scratch_root(spark).removeprefix("file:")).iterdir()}
    before = labels()
    rows = make().collect()
    return {label for label, _ in labels() - before if label != "package"}, rows


def test_only_what_the_result_reads_stays_on_disk(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want, _ = brute([(r["doc_id"], r["text"]) for r in docs.collect()])
    left, rows = _left(spark, lambda: jaccard_join.keep_one(docs))
    assert left == {"jaccard-found", "jaccard-doubtful"}
    assert sorted(r["doc_id"] for r in rows) == sorted(set(want.values()))
    left, rows = _left(spark, lambda: mixing.schedule(docs, (3, 1, 2)))
    assert left == {"mix-uses"} and len(rows) > len(set(want))
    left, rows = _left(spark, lambda: entry.queries()["pipeline"](spark, SF))
    assert left == {"pipeline-byte_bpe"} and all(r["exact"] for r in rows)


def test_rows_are_marked_without_going_through_python(spark, capsys):
    ids = spark.range(2000)
    docs = ids.selectExpr("id", "repeat('text', 9) AS text")
    marked = jaccard_join._mark(docs, "id", jaccard_join._bit_map(ids.filter("id % 7 = 0"), "id"), "may")
    assert marked.filter("may AND text IS NOT NULL AND id % 7 = 0").count() == 286 and marked.filter("may").count() < 300
    marked.explain()
    plan = capsys.readouterr().out
    assert "ArrowEvalPython" in plan and "MapInArrow" not in plan


def _python_steps(plan):
    """The most Python steps that stand in one stage, one above the other."""
    most, above = 0, []  # (depth, steps of the stage so far)
    for line in plan.splitlines():
        depth = re.search(r"[A-Za-z*]", line)
        if not line.strip() or not depth:
            continue
        while above and above[-1][0] >= depth.start():
            above.pop()
        steps = (above[-1][1] if above else 0) + bool(re.search(r"EvalPython|InArrow|InPandas|ExistingRDD", line))
        most = max(most, steps)
        above.append((depth.start(), 0 if "Exchange" in line else steps))
    return most


def test_a_stage_of_the_join_has_one_python_process_a_core(spark, monkeypatch, capsys):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    steps = {}

    def written(df, label="stage"):
        capsys.readouterr()
        df.explain()
        steps[label] = _python_steps(capsys.readouterr().out)
        return cut_lineage(df, label)
    monkeypatch.setattr(jaccard_join, "cut_lineage", written)
    assert jaccard_join.keep_one(docs).count()
    assert {"jaccard-prefixes", "jaccard-members", "jaccard-chosen"} <= set(steps)
    assert max(steps.values()) == 1, steps


def test_row_numbers_need_no_python_process(spark, capsys):
    rows = spark.range(5000, numPartitions=7).selectExpr("id * 7919 % 5000 AS id")
    numbered = row_numbers(rows, [F.col("id")], "place", "numbers")
    assert numbered.filter("place = id").count() == 5000
    capsys.readouterr()
    numbered.explain()
    assert _python_steps(capsys.readouterr().out) == 0
    assert row_numbers(rows.filter("id < 0"), [F.col("id")], "place", "numbers").collect() == []


def test_what_a_task_builds_goes_when_another_operator_comes():
    """Spark keeps a process for later tasks, of any operator; tasks of the same one find what was built."""
    made = []
    batch = pa.record_batch({"x": [1]})

    def run(batches):
        thing = tasks.built("vocabulary", lambda: made.append(1) or object())
        yield from (b for b in batches if thing)
    for _ in range(2):
        assert len(list(tasks.lean(run, "vocabulary")([batch]))) == 1
    assert len(made) == 1 and list(tasks._built) == ["vocabulary"]
    assert len(list(tasks.lean(lambda batches: batches)([batch]))) == 1
    assert not tasks._built
    list(tasks.lean(run, "vocabulary")([batch]))
    tasks.lean_groups(lambda group: group)(pa.table({"x": [1]}))
    assert len(made) == 2 and not tasks._built


@pytest.mark.parametrize("block", [4, 256])
def test_jaccard_counts_every_link(spark, monkeypatch, block):
    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    base = [f"w{i}" for i in range(60)]
    texts = [" ".join(base[:20 + i] + [f"x{i}"] + base[20 + i:]) for i in range(15)]  # all near each other, all different
    texts += texts[:3] + [" ".join(f"c{j}" for j in range(i, i + 40)) for i in range(0, 12, 2)] + ["alone in the world of words"]
    sets = [shingles(t) for t in texts]
    want = {i: sum(4 * len(a & b) >= 3 * len(a | b) for j, b in enumerate(sets) if j != i) for i, a in enumerate(sets)}
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r["doc_id"]: r["n_links"] for r in jaccard_join.components(docs).collect()}
    assert got == want and max(want.values()) > 8


def _held(spark):
    """MB of the largest Python process that is kept for tasks."""
    def probe(batches):
        import os
        import re
        import time

        for _ in batches:
            time.sleep(0.3)  # so that the tasks meet all idle processes
            with open("/proc/self/smaps_rollup") as f:
                kb = sum(map(int, re.findall(r"\nPss_Anon:\s+(\d+)", f.read())))
            yield pa.RecordBatch.from_arrays([pa.array([os.getpid()]), pa.array([kb / 1024])], names=["pid", "mb"])
    cores = spark.sparkContext.defaultParallelism
    return max(r["mb"] for r in spark.range(2 * cores, numPartitions=2 * cores).mapInArrow(probe, "pid bigint, mb double").collect())


def test_idle_processes_give_memory_back(spark):
    """Processes kept for later tasks don't stay as large as the batches they have worked on."""
    text = F.concat_ws(" ", F.transform(F.sequence(F.lit(1), F.lit(500)), lambda k: F.hex(F.xxhash64("doc_id", k))))
    few, many = (spark.range(n, numPartitions=1).select(F.col("id").alias("doc_id")).withColumn("text", text) for n in (20, 6000))
    jaccard_join.keep_one(few).count()  # the modules are loaded
    before = _held(spark)
    assert jaccard_join.keep_one(many).count() == 6000
    assert _held(spark) < before + 10


@pytest.mark.parametrize("classes", [5, 30])
def test_large_regions_in_blocks_against_all_pairs(spark, monkeypatch, classes):
    """Regions of several blocks: links and components as by all pairs, a link once however many regions have it."""
    monkeypatch.setattr(jaccard_join, "BLOCK", 10)
    monkeypatch.setattr(jaccard_join, "BLOCK_CLASSES", classes)
    rows = variants(5, 3, 40, 60) + [(1000 + i, t) for i, t in variants(5, 1, 4, 60)]
    sets = [shingles(t) for _, t in rows]
    links = {rows[i][0]: sum(i != j and 100 * len(a & b) >= 75 * len(a | b) for j, b in enumerate(sets)) for i, a in enumerate(sets)}
    want, _ = brute(rows)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    got = {r["doc_id"]: (r["n_links"], r["component_id"]) for r in jaccard_join.components(docs).collect()}
    assert got == {i: (links[i], want[i, t]) for i, t in rows} and max(links.values()) > 20


def test_strips_of_a_block_give_every_link():
    """A block with itself and two blocks, in several strips, with links that earlier regions have."""
    rng = np.random.default_rng(3)
    base = np.arange(1, 101, dtype=np.uint64) * 977
    sets = []
    for k in range(400):
        one = base + np.uint64(0 if k % 3 else 10 ** 6)
        one[rng.choice(100, rng.integers(0, 12), replace=False)] = rng.integers(10 ** 9, 10 ** 12)
        sets.append(np.unique(one))
    pivots = [[50] + ([7] if k % 5 == 0 else []) for k in range(400)]
    copies = rng.integers(1, 4, 400)
    cls = np.arange(400) + 50
    d = np.array([1 - len(np.intersect1d(s, sets[0])) / len(np.union1d(s, sets[0])) for s in sets])
    linked, parts = np.zeros(400, np.int64), []
    for a, b in itertools.combinations(range(400), 2):
        both = len(np.intersect1d(sets[a], sets[b]))
        if 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both) and not (a % 5 == 0 and b % 5 == 0):
            linked[a], linked[b] = linked[a] + copies[b], linked[b] + copies[a]
            parts.append((cls[a], cls[b]))

    def table(who, i, j, row_side):
        return pa.table({"pivot": pa.array([50] * len(who)), "i": pa.array([i] * len(who)), "j": pa.array([j] * len(who)),
                         "cls": cls[who], "d": d[who], "row_side": row_side, "copies": copies[who],
                         "shingles": pa.array([sets[k].tobytes() for k in who], pa.binary()),
                         "pivots": pa.array([pivots[k] for k in who], pa.list_(pa.int64()))})
    one = rng.permutation(400)[:180]
    two = np.setdiff1d(np.arange(400), one)
    found = [jaccard_join._join_blocks(t) for t in (
        table(one, 0, 0, [True] * 180), table(two, 1, 1, [True] * 220),
        table(np.concatenate([one, two]), 0, 1, [True] * 180 + [False] * 220))]
    got, edges = np.zeros(400, np.int64), []
    for t in found:
        for r in t.to_pylist():
            got[r["a"] - 50] += r["linked"]
            edges += [(r["a"], b) for b in r["tree"]]
    assert got.tolist() == linked.tolist() and linked.max() > 100
    assert reach(cls.tolist(), edges) == reach(cls.tolist(), parts)
    assert len(edges) < 3 * 400  # they span the links, they are not the links


def test_what_leads_to_the_components_goes(spark):
    """Op1: prefixes, sets and region tables go with the step they serve, and links take a row for each class and group."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    left, rows = _left(spark, lambda: jaccard_join.components(docs))
    assert left == {"jaccard-sets", "jaccard-classes", "jaccard-copies", "jaccard-links", "jaccard-edges", "jaccard-components"}
    assert len(rows) == docs.count()


def test_written_tables_leave_no_shuffle_files(spark):
    def shuffles():
        files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {n for n in (files.apply(i).getName() for i in range(files.size())) if n.startswith("shuffle_")}
    before = shuffles()
    table = cut_lineage(spark.range(5000).selectExpr("id % 977 AS k").groupBy("k").count(), "counted")
    until = time.time() + 30
    while shuffles() - before and time.time() < until:
        time.sleep(0.2)  # executors are told, and not waited for
    assert not shuffles() - before
    assert table.count() == 977


@pytest.mark.parametrize("kind", ["float", "double"])
def test_squares_of_tiles_against_all_pairs(spark, monkeypatch, kind):
    """Many small blocks, several to a side, vectors of two lengths, copies: op7 by tasks that read the blocks."""
    monkeypatch.setattr(embed_dedup, "BLOCK_ROWS", 6)
    data = [np.array(v, np.float32).tolist() for v in vectors(2)]
    data += [v[:7] for v in data[:40]] + data[:5]
    docs = spark.createDataFrame(list(enumerate(data)), f"vec_id bigint, embedding array<{kind}>")
    squares = embed_dedup._Squares({7: 7, 24: 50})
    tiles = Counter((d, i, j) for d, rows, columns in map(squares.__getitem__, range(squares.count)) for i in rows for j in columns if i <= j)
    assert tiles == Counter((d, i, j) for d, n in ((7, 7), (24, 50)) for i in range(n) for j in range(i, n))
    assert max(len(squares[k][1]) for k in range(squares.count)) > 1
    want = np.zeros((len(data), len(data)), bool)
    for dims in (7, 24):
        own = [i for i, v in enumerate(data) if len(v) == dims]
        unit = np.array([data[i] for i in own], np.float64)
        unit /= np.linalg.norm(unit, axis=1)[:, None]
        want[np.ix_(own, own)] = unit @ unit.T >= 0.95
    np.fill_diagonal(want, False)
    root = reach(range(len(data)), list(zip(*np.nonzero(want))))
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embed_dedup.near_duplicates(docs).collect()}
    assert got == {i: (int(want[i].sum()), root[i], root[i] == i) for i in range(len(data))}


def test_a_strip_full_of_links_spans_them():
    class Block:
        def __init__(self, ids):
            self.ids = np.array(ids)
    x, y = Block(range(100, 140)), Block(range(200, 230))
    links = [(i, j) for i in range(40) for j in range(30) if i % 3 == j % 3]
    found = embed_dedup._edges(x, y, *np.array(links).T)
    every = [*x.ids.tolist(), *y.ids.tolist()]
    assert len(found) <= 70 and reach(every, found.tolist()) == reach(every, [(100 + i, 200 + j) for i, j in links])


def test_blocks_of_vectors_are_not_moved_for_each_tile(spark, monkeypatch, capsys):
    """Op7: the tiles are worked on without an exchange or a join, and the blocks go when that is done."""
    monkeypatch.setattr(embed_dedup, "BLOCK_ROWS", 40)
    rows = spark.createDataFrame(list(enumerate(vectors(1))), "vec_id bigint, embedding array<double>").repartition(3)
    left, found = _left(spark, lambda: embed_dedup.near_duplicates(rows))
    assert left == {"vectors", "vector-copies", "tile-links", "vector-components", "vector-parts"} and len(found) == 303
    reps = spark.createDataFrame([(v, i, 1) for i, v in enumerate(vectors(1)[:300])], "v array<double>, rep bigint, copies bigint")
    capsys.readouterr()
    embed_dedup._tile_links(reps, {24: 300}, 0.95).explain()
    plan = capsys.readouterr().out
    assert "MapInArrow" in plan and "Exchange" not in plan and "Join" not in plan


def test_tables_behind_the_regions_go_before_sets_move(spark, monkeypatch):
    """The pipeline's join: prefixes, pivots and members, the largest tables, aren't there when the sets of regions are."""
    docs, seen, old = spark.read.parquet(f"{SF}/documents.parquet"), [], jaccard_join._region_links

    def listed():
        return {p.name.rpartition("-")[::2] for p in Path(scratch_root(spark).removeprefix("file:")).iterdir()}
    before = listed()

    def region_links(member, sets):
        seen.append({label for label, _ in listed() - before})
        return old(member, sets)
    monkeypatch.setattr(jaccard_join, "_region_links", region_links)
    kept = corpus_pipeline.keep_one_copy(spark, docs, SF)
    want, _ = brute([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(want.values()))
    assert len(seen) == 1 and {"jaccard-regions", "jaccard-chosen"} <= seen[0]
    assert not seen[0] & {"jaccard-prefixes", "jaccard-pivots", "jaccard-members", "region-members"}
