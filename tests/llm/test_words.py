"""Operators on documents against brute force, with nulls, ties, repeats, empty tables and clashing columns."""

import hashlib
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from spindrift.llm import common, decontam, linededup, ngramjoin, packing, secrets, sharding, substrings, textops, trigrams
from spindrift.llm.components import connected_components

WORD = re.compile("[^\x20\x09-\x0d]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, texts, start=0):
    return spark.createDataFrame([(i + start, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], SCHEMA)


@pytest.fixture(scope="module")
def texts():
    """Random prose with exact and near copies, shared passages, odd cases, a large group of copies."""
    rng = random.Random(4)
    vocabulary = ["".join(rng.choice("abcdeéü") for _ in range(rng.randint(1, 6))) for _ in range(300)]
    say = lambda n: " ".join(rng.choice(vocabulary) + rng.choice(["", "", ".", ","]) for _ in range(n))
    base = [say(rng.randint(3, 160)) for _ in range(40)]
    passage = say(70)
    out = [None, "", " \t\n", "one", "ONE", "one two three four", "a b c d e", "a b c d E", "\x1c\x1d x"]
    out += base
    for t in base[:20]:
        w = t.split()
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(len(w))] = "edit"
        out.append(" ".join(w))
    out += [say(20) + " " + passage + "\n" + say(15) for _ in range(6)]
    out += [base[3]] * 25
    out += [base[4].upper(), base[5].replace(" ", "\n"), say(6000)]
    rng.shuffle(out)
    return out


def brute_components(texts):
    sets = []
    for t in texts:
        w = WORD.findall((t or "").translate(LOWER))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    comp = list(range(len(texts)))
    changed = True
    linked = [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])]
    while changed:
        changed = False
        for i, j in linked:
            m = min(comp[i], comp[j])
            changed |= comp[i] != m or comp[j] != m
            comp[i] = comp[j] = m
    return [len(s) for s in sets], comp


def test_ngram_join(spark, texts):
    sizes, comp = brute_components(texts)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngramjoin.shingle_components(frame(spark, texts), block=8).collect()}
    assert got == {i: (n, c) for i, (n, c) in enumerate(zip(sizes, comp))}


def test_ngram_join_edges(spark):
    assert ngramjoin.shingle_components(frame(spark, [])).count() == 0
    odd = frame(spark, ["a b c d e f", "a b c d e f", None]).withColumn("component", F.lit(7)).withColumn("rep", F.lit("x"))
    odd = odd.unionByName(odd.where("doc_id = 1")).unionByName(odd.where("doc_id = 0").withColumn("doc_id", F.lit(None).cast("long")))
    got = sorted(((r.doc_id, r.component_id) for r in ngramjoin.shingle_components(odd).collect()), key=str)
    assert [g for g in got if g[0] is not None] == [(0, 0), (1, 0), (1, 0), (2, 2)] and len(got) == 5
    kept = ngramjoin.keep_one_of_each(odd)
    assert kept.columns == odd.columns and sorted(str(r.doc_id) for r in kept.collect()) == ["0", "2", "None"]
    # Repeated rows of the least id leave one; one id with two texts is judged by its texts.
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f"), (3, "p q r s t"), (3, "a b c d e f"), (4, "P Q R S T"), (5, None), (5, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("own", F.lit(1)).withColumn("gone", F.lit(2))
    got = sorted(map(tuple, ngramjoin.shingle_components(df).collect()))
    assert got == [(1, 2, 1), (1, 2, 1), (2, 2, 1), (3, 1, 3), (3, 2, 1), (4, 1, 3), (5, 0, 5), (5, 0, 5)]
    assert sorted((r.doc_id, str(r.text)) for r in ngramjoin.keep_one_of_each(df).collect()) == [(1, "a b c d e f"), (3, "p q r s t"), (5, "None")]


def test_few_documents_take_few_tasks(spark):
    """Same result as by shuffles, whatever is dealt by one task, in far fewer tasks."""
    rng = random.Random(33)
    bases = [[f"w{g}x{i}" for i in range(rng.choice([6, 9, 40, 60]))] for g in range(40)]
    texts = []
    for g, b in enumerate(bases):
        for _ in range(60 if g == 0 else rng.randint(1, 6)):
            w = list(b)
            for _ in range(rng.randint(0, 3)):
                w[rng.randrange(len(w))] = f"e{rng.randrange(40)}"
            texts.append(" ".join(w) + " common words that all texts end with" * (g % 3 == 0))
    rng.shuffle(texts)
    sizes, comp = brute_components(texts)
    want = {i: (n, c) for i, (n, c) in enumerate(zip(sizes, comp))}
    sc, conf, tasks = spark.sparkContext, {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}, {}
    before = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        for one_task in (0, 200_000):
            sc.setJobGroup(f"join {one_task}", "")
            got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngramjoin.shingle_components(frame(spark, texts), block=8, one_task=one_task).collect()}
            assert got == want
            told = sc.statusTracker()
            stages = {s for j in told.getJobIdsForGroup(f"join {one_task}") for s in told.getJobInfo(j).stageIds}
            tasks[one_task] = sum(told.getStageInfo(s).numCompletedTasks for s in stages if told.getStageInfo(s))
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
        for k, v in before.items():
            spark.conf.set(k, v)
    assert tasks[200_000] < 0.5 * tasks[0], tasks


def test_few_blocks_cover_all_pairs():
    """Any two documents of a group that can link and are not connected meet in a pair of blocks."""
    rng = np.random.Generator(np.random.PCG64(8))
    n = 400
    group, d, component, size = rng.integers(0, 4, n), np.arange(n), rng.integers(0, 90, n), rng.integers(1, 60, n)
    component[100:160], group[100:160], size[100:160] = 7, 2, 30
    rows = pa.RecordBatch.from_arrays([pa.array(x) for x in (group, d, component, size)], list("gdcn"))
    placed = next(ngramjoin._place_few(ngramjoin._class_width(75, 100), 8)(iter([rows.slice(0, 150), rows.slice(150)])))
    block = dict(zip(placed["d"].to_pylist(), placed["b"].to_pylist()))
    assert sorted(block) == list(range(n)) and max(Counter(block.values()).values()) < 30
    told = {}
    for b in ngramjoin._near_few(iter([placed.select(["component", "b", "group", "c"])])):
        for x, one, two in zip(*(c.to_pylist() for c in b.columns)):
            told.setdefault((one, two), []).append(x)
    assert all(sorted(x) == sorted({*pair}) for pair, x in told.items())
    for i in range(n):
        for j in range(i):
            if group[i] == group[j] and component[i] != component[j] and 4 * min(size[i], size[j]) >= 3 * max(size[i], size[j]):
                assert tuple(sorted((block[i], block[j]))) in told


def test_crowded_groups_split(spark):
    from spindrift.llm.common import split_groups

    df = spark.range(1000).select("id", F.when(F.col("id") < 600, 0).when(F.col("id") < 700, 1).otherwise(F.col("id")).alias("g"), F.lit("x").alias("many"))
    out = split_groups(df, ["g"], "id", 50, "part").toPandas()
    assert sorted(out.id) == list(range(1000)) and out.groupby(["g", "part"]).size().max() < 100
    assert (out[out.g == 0].part_parts == 12).all() and (out[out.g > 1].part == 0).all()


def test_trees_carry_the_join(spark):
    """Documents of one hot passage and near copies of each other: links come from the trees, most pairs are pruned."""
    rng = random.Random(21)
    passage = " ".join(f"p{i}" for i in range(40))
    texts = []
    for g in range(25):
        own = [f"w{g}x{i}" for i in range(110)]
        for _ in range(8):
            w = list(own)
            for _ in range(2):
                w[rng.randrange(len(w))] = f"e{rng.random()}"
            texts.append(" ".join(w) + " " + passage)
    sizes, comp = brute_components(texts)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngramjoin.shingle_components(frame(spark, texts), block=16).collect()}
    assert got == {i: (n, c) for i, (n, c) in enumerate(zip(sizes, comp))}
    sets = [np.concatenate(w.shingles(5)) for t in texts for _, _, w in textops.words_of(pa.array([t]), True)]
    sets = [np.sort(s) for s in sets]
    near = [tuple(int(textops.mix(s ^ m).min()) for m in ngramjoin.MIXINGS) for s in sets]
    tree = ngramjoin.SignatureTree(sets, list(range(len(sets))), 75, 100, near)
    root = tree.build(list(range(len(sets))))
    tree.search(root, root)
    assert len({tree.root(i) for i in range(len(sets))}) == len(set(comp))
    assert tree.pruned > 0.9 * len(sets) * (len(sets) - 1) / 2 and tree.verified < 600


def test_signature_tree_finds_every_link():
    rng = np.random.default_rng(3)
    base = [np.unique(rng.integers(0, 2**63, 40).astype(np.uint64)) for _ in range(12)]
    sets = [b for b in base]
    for b in base:
        for _ in range(4):
            c = b.copy()
            c[rng.integers(0, len(c), 3)] = rng.integers(0, 2**63, 3)
            sets.append(np.unique(c))
    tree = ngramjoin.SignatureTree(sets, list(range(len(sets))), 75, 100)
    a = tree.build(list(range(len(sets))))
    tree.search(a, a)
    for i in range(len(sets)):
        for j in range(i):
            if ngramjoin.links(len(np.intersect1d(sets[i], sets[j])), len(sets[i]), len(sets[j]), 75, 100):
                assert tree.root(i) == tree.root(j)
    two = ngramjoin.SignatureTree(sets, list(range(len(sets))), 75, 100)
    two.search(two.build(list(range(30))), two.build(list(range(30, len(sets)))))
    assert all(i < 30 <= j or j < 30 <= i for i, j in two.found)


@pytest.mark.parametrize("n", range(1, 24))
def test_signature_trees_of_any_size(n):
    """Nodes with a single child lose no pair."""
    rng = np.random.default_rng(n)
    base = np.unique(rng.integers(0, 2**63, 60).astype(np.uint64))
    other = [np.unique(rng.integers(0, 2**63, 60).astype(np.uint64)) for _ in range(n - 1)]
    near = base.copy()
    near[:3] += np.uint64(1)
    sets = [base, *other, np.unique(near)]
    tree = ngramjoin.SignatureTree(sets, list(range(n + 1)), 75, 100)
    a = tree.build(list(range(n + 1)))
    assert [tuple(sorted(f)) for f in tree.search(a, a)] == [(0, n)]
    for cut in range(1, n + 1):
        two = ngramjoin.SignatureTree(sets, list(range(n + 1)), 75, 100)
        found = two.search(two.build(list(range(cut))), two.build(list(range(cut, n + 1))))
        assert [tuple(sorted(f)) for f in found] == [(0, n)]


def test_substrings(spark, texts):
    words = [WORD.findall(t or "") for t in texts]
    first = {}
    for i, w in enumerate(words):
        for k in range(len(w) - 49):
            first.setdefault(tuple(w[k : k + 50]), i)
    got = {r.doc_id: r for r in substrings.remove_repeats(frame(spark, texts), group_mb=0.01, sample_docs=30).collect()}
    removed = 0
    for i, w in enumerate(words):
        gone = [False] * len(w)
        for k in range(len(w) - 49):
            if first[tuple(w[k : k + 50])] < i:
                gone[k : k + 50] = [True] * 50
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        assert (got[i].n_words, got[i].n_removed, got[i].kept) == (len(w), sum(gone), kept)
        assert got[i].kept_sha256 == hashlib.sha256(kept.encode()).hexdigest()
        removed += sum(gone)
    assert removed > 1000


def test_substrings_edges(spark):
    assert substrings.remove_repeats(frame(spark, [])).count() == 0
    long = " ".join(map(str, range(60)))
    df = frame(spark, [long, long]).withColumn("flags", F.lit(1)).withColumn("part", F.lit(1))
    df = df.unionByName(df.where("doc_id = 1")).unionByName(df.where("doc_id = 0").withColumn("doc_id", F.lit(None).cast("long")))
    got = sorted((str(r.doc_id), r.n_removed) for r in substrings.remove_repeats(df).collect())
    assert got == [("0", 0), ("1", 60), ("1", 60), ("None", 0)]
    # One id with two texts: each row loses what is its own; maximal repeats are reported.
    other = " ".join(f"x{i}" for i in range(70))
    rows = [(0, long), (1, long + " " + other), (2, other), (2, "p q " + long), (3, long), (3, "short"), (4, None), (5, other + " mid " + long)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id, r.n_words, [tuple(x) for x in r.repeats]) for r in substrings.remove_repeats(df).collect())
    assert got == [(0, 60, []), (1, 130, [(0, 60)]), (2, 62, [(2, 60)]), (2, 70, [(0, 70)]), (3, 1, []), (3, 60, [(0, 60)]), (4, 0, []), (5, 131, [(0, 70), (71, 60)])]


def test_subtree_nodes_nest():
    rng = np.random.default_rng(5)
    way, labels, docs = rng.integers(0, 3, 400).astype(np.uint16) * 257, rng.integers(0, 40, 400).astype(np.uint64), rng.integers(0, 50, 400)
    tree = substrings.Subtree(way, labels)
    for above, below in zip(tree.nodes, tree.nodes[1:]):
        assert set(above) <= set(below)
    least = tree.least(docs)
    assert all(least[i] == docs[(way == way[i]) & (labels == labels[i])].min() for i in range(400))
    assert substrings.Subtree(way[:0], labels[:0]).least(docs[:0]).tolist() == []


@pytest.mark.parametrize("run", [1, 2, 3])
def test_lines_equal_sql(spark, run):
    rng = random.Random(run)
    docs = ["\n".join(rng.choice("abcdef") for _ in range(rng.randint(0, 12))) for _ in range(60)] + [None, "", "x\ny\nz", "x\ny\nz", "\n\n\n\n"]
    df = frame(spark, docs)
    got = sorted(map(tuple, linededup.line_digest(df, run).collect()))
    con = duckdb.connect()
    con.register("documents", df.toPandas())
    assert got == sorted(con.sql(linededup.oracle(run)).fetchall())


def test_lines_edges(spark):
    assert linededup.dedup_lines(frame(spark, [])).count() == 0
    df = frame(spark, ["a\nb\nc\nd", "a\nb\nc\ne"]).withColumn("n_lines", F.lit("old")).withColumn("gone", F.lit(1)).withColumn("h", F.lit(2))
    df = df.unionByName(df.where("doc_id = 1"))
    out = linededup.dedup_lines(df)
    assert sorted((r.doc_id, r.text, r.n_lines, r.n_removed, r.gone) for r in out.collect()) == [(0, "a\nb\nc\nd", 4, 0, 1), (1, "e", 4, 3, 1), (1, "e", 4, 3, 1)]


def test_short_runs_count_by_their_words(spark):
    rng = random.Random(9)
    pool = ["", "a b", "c d e", "  f ", "one two three four five six", "g\th i", "seven eight nine ten eleven"]
    docs = ["\n".join(rng.choice(pool) for _ in range(rng.randint(0, 5))) + f"\nown {i}" for i in range(40)]
    docs += [f"start {i}\nthis one line stands in very many documents\nend {i}" for i in range(30)]
    lines = [d.split("\n") for d in docs]
    gone = [set() for _ in docs]
    for run in (1, 2, 3):
        seen = set()
        for i, own in enumerate(lines):
            for s in range(len(own) - run + 1):
                key = tuple(own[s : s + run])
                if run == 3 or sum(len(x.split()) for x in key) >= 5:
                    gone[i] |= set(range(s, s + run)) if key in seen else set()
                    seen.add(key)
    want = [(i, "\n".join(x for j, x in enumerate(own) if j not in gone[i]), len(gone[i])) for i, own in enumerate(lines)]
    out = linededup.dedup_lines(frame(spark, docs), words=5).collect()
    assert sorted((r.doc_id, r.text, r.n_removed) for r in out) == want
    import corpus_pipeline

    kept = {r.doc_id: r.text for r in corpus_pipeline.line_dedup(spark, frame(spark, docs).withColumn("n_chars", F.length("text").cast("long")), "").collect()}
    assert kept == {i: t for i, t, n in want if not n or t.strip()}


def test_line_dedup_does_not_hide_near_copies(spark, tmp_path):
    import corpus_pipeline

    lines = [" ".join(f"w{i}x{j}" for j in range(30)) for i in range(12)]
    edited = [x.replace("w3x7", "other") for x in lines]
    docs = frame(spark, ["\n".join(lines), "\n".join(edited), "\n".join(reversed(lines[:2])) + "\nand seven more words of its own"]).withColumn("n_chars", F.length("text").cast("long"))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    left = corpus_pipeline.near_copies(spark, corpus_pipeline.line_dedup(spark, docs, str(tmp_path)), str(tmp_path)).collect()
    assert sorted((r.doc_id, r.text) for r in left) == [(0, "\n".join(lines)), (2, "and seven more words of its own")]


def shuffled(spark):
    """(stage, bytes) that each stage so far wrote to shuffles."""
    jvm = spark.sparkContext._jvm
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
    return [(stages.apply(i).stageId(), stages.apply(i).shuffleWriteBytes()) for i in range(stages.size())]


def test_near_copies_leave_texts_where_they_are(spark, tmp_path):
    """The stage's joins by id shuffle no texts: a long word is one token of a set, and 6 MB of texts are not written."""
    import corpus_pipeline

    rng = random.Random(35)
    texts = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz0123456789", k=20_000)) for _ in range(300)]
    docs = frame(spark, [*texts, *texts[:4], None]).withColumn("doc_id", F.when(F.col("doc_id") != 7, F.col("doc_id")))
    docs = docs.unionByName(docs.where("doc_id = 9"))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    before = max((k for k, _ in shuffled(spark)), default=-1)
    left = corpus_pipeline.near_copies(spark, docs.where("doc_id is null or doc_id <> 11"), str(tmp_path))
    assert sorted((str(r.doc_id), r.text) for r in left.collect()) == sorted((str(None if i == 7 else i), t) for i, t in enumerate([*texts, *[None] * 5]) if i != 11 and not 300 <= i < 304)
    assert sum(n for k, n in shuffled(spark) if k > before) < 1_000_000


def test_rest_of_is_an_anti_join(spark):
    df = spark.createDataFrame([(i % 50 if i % 7 else None, i % 3, i) for i in range(300)], "a long, b int, maybe int")
    for away in ([], [(3, 1), (None, 2), (49, None)], [(i, i % 3) for i in range(40)]):
        got = common.rest_of(df, spark.createDataFrame(away, "a long, b int"), "a", "b")
        assert got.columns == df.columns
        assert sorted(r.maybe for r in got.collect()) == [r.maybe for r in df.orderBy("maybe").collect() if (r.a, r.b) not in set(away)]


def weighted(a, b, k=5):
    grams = lambda w: Counter(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else Counter([tuple(w)])
    a, b = grams(a), grams(b)
    return sum((a & b).values()) / sum((a | b).values())


def test_decontamination(spark, texts):
    rng = random.Random(9)
    items = [" ".join(rng.choice(["qa", "qb", "qc", "qd", "qe", "qf", "qg"]) + str(rng.randint(0, 9)) for _ in range(n)) for n in (1, 3, 5, 17, 30, 45, 60)] + [None, ""]
    docs = list(texts)
    for it in items[:7]:
        w = it.split()
        docs += ["x y " + it.upper() + " z", it, "lead " + " ".join(w[: len(w) // 2]) + " tail"]
        if len(w) > 20:
            docs.append("p q " + " ".join(w[:-1] + ["changed"]) + " r")
            docs.append("p " + " ".join(w[1:]) + " r s")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.start, round(r.similarity, 9)) for r in decontam.contaminated(frame(spark, docs), bench).collect()}
    want = {}
    for i, t in enumerate(docs):
        w = [x for x in re.split("[\x20\x09-\x0d]+", (t or "").lower()) if x]
        for j, it in enumerate(items):
            v = (it or "").lower().split()
            if not v or not w:
                continue
            best = max(((weighted(w[s : s + len(v)], v, min(5, len(v))), -s) for s in range(max(1, len(w) - len(v) + 1))), default=(0, 0))
            if best[0] >= 0.75:
                want[i, j] = round(best[0], 9)
    assert {k: s for k, (_, s) in got.items()} == want and len(want) > 15
    clean = decontam.drop_contaminated(frame(spark, docs), bench)
    assert {r.doc_id for r in clean.collect()} == set(range(len(docs))) - {i for i, _ in want}


def test_decontamination_edges(spark):
    bench = spark.createDataFrame([(1, "a b c d e f g")], "item_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    docs = frame(spark, ["a b c d e f g"]).withColumn("item_id", F.lit(5)).withColumn("sim", F.lit(1))
    assert decontam.contaminated(docs, none).count() == 0 and decontam.contaminated(docs.limit(0), bench).count() == 0
    assert [tuple(r)[:4] for r in decontam.contaminated(docs.unionByName(docs), bench.unionByName(bench)).collect()] == [(0, 1, 0, 7)]


def test_simhash_blocks_cover_the_radius(spark):
    """Whatever 19 bits change, a flipped block of the item meets a flipped block of the window."""
    df = spark.createDataFrame([([f"w{i}" for i in range(30)],)], "w array<string>").select(decontam.simhash(F.col("w")).alias("s"))
    s = df.first().s
    rng = random.Random(1)
    changed = [sum(1 << b for b in rng.sample(range(64), decontam.RADIUS)) for _ in range(40)]
    changed += [sum(1 << (16 * b + i) for b, m in enumerate(many) for i in rng.sample(range(16), m)) for many in ((5, 5, 5, 4), (4, 5, 5, 5), (0, 9, 10, 0))]
    rows = spark.createDataFrame([(int(np.uint64((s & (2**64 - 1)) ^ f).astype(np.int64)),) for f in changed], "t long")
    both = rows.select(decontam._keys(F.lit(s), decontam.ITEM_FLIPS).alias("a"), decontam._keys(F.col("t"), decontam.WINDOW_FLIPS).alias("b"))
    assert all(set(r.a) & set(r.b) for r in both.collect())
    assert len(both.first().a) == 4 * 697 and len(both.first().b) == 4 * 17


def test_decontamination_by_rows(spark):
    """Null ids, and one id with two texts: every row is judged by its own text."""
    item = " ".join(f"i{n}" for n in range(20))
    rows = [(None, "lead " + item), (None, "clean words of a null id here"), (5, item), (5, "the same id with clean words"), (6, None), (7, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("row", F.lit(1)).withColumn("did", F.lit(2))
    bench = spark.createDataFrame([(None, item), (2, "")], "item_id long, text string")
    out = decontam.drop_contaminated(df, bench)
    assert out.columns == df.columns and sorted(map(str, (r.text for r in out.collect()))) == sorted(map(str, (rows[i][1] for i in (1, 3, 4, 5))))


def brute_secrets(text):
    name = "(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
    assign = [(m.start(), 0, m.end()) for m in re.finditer(name + r"[\"']? *[:=] *[\"']?([A-Za-z0-9+/_.=-]+)", text) if len(m[1]) >= 8]
    access = [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if m.end() - m.start() >= 16]
    hexes = [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if m.end() - m.start() >= 32]
    return sorted(assign + access + hexes)


def test_secrets(spark):
    rng = random.Random(2)
    bits = ["password", "PassWD", "secret", "Token", "api_key", "APIKEY", "=", ": ", " = ", '"', "'", "abcdefgh", "short", "AKIA", "ABCDEFGHIJKL", "0123456789abcdef" * 2, "é", "ſ", "-----BEGIN RSA PRIVATE KEY-----", "\n", "ghp_" + "a" * 36]
    docs = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 25))) for _ in range(400)] + [None, ""]
    names = ("assign", "access", "hex")
    for r in secrets.scan_secrets(frame(spark, docs).withColumn("spans", F.lit(1))).collect():
        want = brute_secrets(docs[r.doc_id] or "")
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(w[1] == k for w in want) for k in range(3))
        base = ",".join(f"{names[k]}:{a}:{z}" for a, k, z in want)
        assert r.base_sha256 == hashlib.sha256(base.encode()).hexdigest()
        assert ",".join(s for s in r.spans.split(",") if s.split(":")[0] in names) == base
    assert secrets.scan_secrets(frame(spark, [])).count() == 0


def test_rules_find_their_examples():
    examples = {"pem": "-----BEGIN EC PRIVATE KEY-----", "github": "gho_" + "b" * 36, "slack": "xoxb-1234567890", "jwt": "eyJhbGciOiJI.eyJzdWIiOiIx.abcdefgh", "google": "AIza" + "c" * 35, "access": "AKIA" + "Z" * 16, "assign": "API_KEY=abcdefgh1", "hex": "f" * 32}
    for rule in secrets.BASE + secrets.ADDED:
        found = secrets.Scanner((rule,)).scan(pa.array(["no such thing", examples[rule.kind], None]))
        assert [[k for _, k, _ in f] for f in found] == [[], [0], []]


def test_queries_come_from_the_patterns():
    tri = lambda *ts: ("and", frozenset(("tri", t) for t in ts))
    assert trigrams.query_of("hello") == tri(b"hel", b"ell", b"llo")
    assert trigrams.query_of("AB[cd]E?f") == trigrams.query_of("abcef|abdef|abcf|abdf")
    assert trigrams.query_of("abc.*xyz") == tri(b"abc", b"xyz")
    assert trigrams.query_of("(?:abcd){2,}") == tri(b"abc", b"bcd", b"cda", b"dab")
    for free in ("[0-9a-f]+", "a.b", "ab|xyz", "(abc)*", "a?b?c?", "(?i)kisk", "[^a]bc"):
        assert trigrams.query_of(free) == trigrams.ALL
    assert [trigrams.query_of(r.pattern) != trigrams.ALL for r in secrets.BASE + secrets.ADDED] == [True, True, False, True, True, True, True, True]


def test_queries_lose_no_match():
    """Random patterns over a small alphabet: the index gives every text that a full scan finds."""
    rng = random.Random(12)

    def pattern(depth: int) -> str:
        kind = rng.randrange(9 if depth else 4)
        if kind < 3:
            return "".join(rng.choice("abcAé") for _ in range(rng.randint(1, 4)))
        if kind == 3:
            return rng.choice(["[ab]", "[^a]", ".", "[a-c]", r"\b", "^", "(?=a)", r"\w", "[é1]"])
        if kind == 4:
            return f"(?:{pattern(depth - 1)}|{pattern(depth - 1)})"
        if kind == 5:
            return f"(?:{pattern(depth - 1)}){rng.choice(['*', '+', '?', '{2}', '{1,3}', '+?', '{0,2}', '{2,}', '*+', '{9,}'])}"
        if kind == 6:
            return f"({pattern(depth - 1)})"
        return pattern(depth - 1) + pattern(depth - 1)

    words = ["".join(rng.choice("abcABé1") for _ in range(rng.randint(0, 14))) for _ in range(500)] + [None, "abcabcabcabcabcabcabc" * 3]
    col, asked, kept = pa.array(words), 0, 0
    for n in range(300):
        p = re.compile(pattern(3), re.I if n % 4 == 0 else 0)
        q = trigrams.query_of(p)
        got = set(trigrams.TrigramIndex([q]).fill(*textops.buffers(col)).ask(q).tolist())
        want = {i for i, w in enumerate(words) if p.search(w or "")}
        assert want <= got, (p.pattern, p.flags)
        if q != trigrams.ALL:
            asked, kept = asked + len(words), kept + len(got)
    assert asked > 50 * len(words) and kept < 0.3 * asked


def test_shards(spark, texts):
    docs = frame(spark, texts * 3 + [texts[-1] or "x"] * 150)
    docs = docs.unionByName(docs.where("doc_id = 3")).unionByName(docs.where("doc_id = 5").withColumn("doc_id", F.lit(None).cast("long"))).withColumn("shard", F.lit(9)).withColumn("range", F.lit("r"))
    rows = sharding.shard(docs).collect()
    assert len(rows) == docs.count()
    by = {}
    for r in rows:
        by.setdefault(r.shard, []).append(r)
    sums = [sum(r["size"] for r in by.get(k, [])) for k in range(8)]
    largest = max(r["size"] for r in rows)
    assert max(sums) - min(sums) <= 2 * largest
    for k, rs in by.items():
        assert sorted(r.slot for r in rs) == list(range(len(rs)))
    text = {i: t for i, t in enumerate(texts * 3 + [texts[-1] or "x"] * 150)}
    assert all(r.size == len((text[r.doc_id] or "").encode()) + 1 and r.text_crc32 == zlib.crc32((text[r.doc_id] or "").encode()) for r in rows if r.doc_id is not None)
    assert sharding.shard(docs.limit(0)).count() == 0


def tokenizer_path():
    from spindrift.llm.queries import tokenizer_path

    return tokenizer_path()


def test_packing_round_trip(spark, texts):
    from tokenizers import Tokenizer

    docs = frame(spark, texts + ["don't 'RE <|endoftext|> ''s 12a3 日本 \x1c ı"]).withColumn("start", F.lit(1))
    rows = packing.pack(docs.repartition(3), tokenizer_path(), width=256, block_tokens=3000).collect()
    t = Tokenizer.from_file(tokenizer_path())
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
    for d in docs.collect():
        ids = np.array(t.encode(d.text or "", add_special_tokens=False).ids + [1], dtype="<u4")
        at = 0
        for r in sorted(by_doc[d.doc_id], key=lambda r: r["start"]):
            assert r["start"] == at and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    for rs in by_seq.values():
        at = 0
        for r in sorted(rs, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 256
    fill = sum(r.length for r in rows) / 256 / len(by_seq)
    assert fill > 0.93
    assert packing.pack(frame(spark, []), tokenizer_path()).count() == 0


def test_cuts_are_optimal():
    rng = random.Random(6)
    for _ in range(60):
        gaps = [rng.randint(1, 7) for _ in range(rng.randint(1, 9))]
        bounds = [0]
        for g in gaps:
            bounds.append(bounds[-1] + g)
        pen = [rng.choice([0.0, 2.0, 5.0]) for _ in bounds]
        cost = lambda cuts: sum(10 - (bounds[b] - bounds[a]) + pen[b] for a, b in zip(cuts, cuts[1:]))
        best = float("inf")
        for mask in range(1 << max(0, len(bounds) - 2)):
            cuts = [0, *(i + 1 for i in range(len(bounds) - 2) if mask >> i & 1), len(bounds) - 1]
            if all(bounds[b] - bounds[a] <= 10 for a, b in zip(cuts, cuts[1:])):
                best = min(best, cost(cuts))
        assert cost(packing.choose_cuts(bounds, pen, 10)) == best


def test_pieces_equal_the_tokenizer():
    table = packing._pieces(tokenizer_path())
    rng = random.Random(3)
    alphabet = "abzAZéÉÀßñü019,.'!-_ \t\n’×÷ıſİŉ<|>日ﬁ\x1c\x0b "
    xs = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40))) for _ in range(800)] + ["".join(rng.choice("asdtmrelv'' ,S") for _ in range(20)) for _ in range(800)] + [None, ""]
    assert table.plain
    for x, got in zip(xs, table.ids(pa.array(xs))):
        assert got.tolist() == table.tokenizer.encode(x or "", add_special_tokens=False).ids


def test_words_match_the_pattern(texts):
    for lower in (False, True):
        n = 0
        for i, j, w in textops.words_of(pa.array(texts, pa.string()).slice(2), lower):
            for d in range(j - i):
                own = WORD.findall((texts[2 + i + d] or ""))
                a, z = w.first[d], w.first[d + 1]
                assert z - a == len(own)
                n += len(own)
        seen = {}
        for i, j, w in textops.words_of(pa.array(texts, pa.string()), lower):
            flat = [x.translate(LOWER) if lower else x for t in texts[i:j] for x in WORD.findall(t or "")]
            for h, x in zip(w.hash.tolist(), flat):
                assert seen.setdefault(h, x) == x
            assert len({x for x in flat}) == len(set(w.hash.tolist()))


def test_components(spark):
    edges = [(1, 2), (2, 3), (3, 1), (10, 11), (5, 5), (None, 4), (20, 21)] + [(100 + i, 101 + i) for i in range(60)] + [(200, 200 + i) for i in range(1, 300)]
    frame_of = spark.createDataFrame(edges, "u long, v long")
    got = {r.node: r.component for r in connected_components(frame_of, one_task=0).collect()}
    assert got == {r.node: r.component for r in connected_components(frame_of).collect()}
    assert {n: got[n] for n in (1, 2, 3, 10, 11, 20, 21)} == {1: 1, 2: 1, 3: 1, 10: 10, 11: 10, 20: 20, 21: 20}
    assert all(got[100 + i] == 100 for i in range(61)) and all(got[200 + i] == 200 for i in range(300)) and 5 not in got
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_a_worker_keeps_the_tables_of_one_operator():
    from spindrift.llm.queries import tokenizer_path

    col = pa.array(["One two three.", None, "", "Four five"])
    table = packing._pieces(tokenizer_path())
    ids = [x.tolist() for x in table.ids(col)]
    assert packing._pieces(tokenizer_path()) is table
    sets = [s.tolist() for _, _, w in textops.words_of(col, lower=True) for s in w.shingles(2)]
    assert "packing" not in common._kept
    again = packing._pieces(tokenizer_path())
    assert again is not table and [x.tolist() for x in again.ids(col)] == ids
    assert [s.tolist() for _, _, w in textops.words_of(col, lower=True) for s in w.shingles(2)] == sets
