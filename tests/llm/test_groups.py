"""Joins over groups of copies against brute force."""

import random

import numpy as np
from pyspark.sql import functions as F

from volpanel.llm import chat, graph, jaccard, jaccard_postings, near_vectors


def closure(ids, links):
    parent = {i: i for i in ids}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        x, y = top(a), top(b)
        parent[max(x, y)] = min(x, y)
    return {i: top(i) for i in ids}


def test_components_of_a_path_a_star_and_a_ring(spark):
    links = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 40)] + [(200 + i, 200 + (i + 1) % 9) for i in range(9)] + [(7, 7)]
    rnd = random.Random(1)
    rnd.shuffle(links)
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == closure({x for l in links for x in l}, links)
    assert graph.components(spark.createDataFrame([], "a long, b long")).collect() == []


def shingle_set(text):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\x0b", " ").split(" ")
    w = [x for part in w for x in part.replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\x0c", " ").split(" ") if x]
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_jaccard_join_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "CHUNK", 8)  # so that groups are cut into several chunks
    rnd, texts = random.Random(2), [None, "", " \t\n", "one two", "ONE two", "a b c d e", "a b c d e f"]
    vocabulary = [f"w{i}" for i in range(400)]
    passage = " ".join(rnd.choice(vocabulary) for _ in range(12))
    for _ in range(12):
        base = [rnd.choice(vocabulary) for _ in range(rnd.choice([6, 20, 60, 150]))]
        for _ in range(rnd.choice([1, 4, 30])):
            copy = list(base)
            for _ in range(rnd.choice([0, 1, 1, 2, 3])):
                copy[rnd.randrange(len(copy))] = rnd.choice(vocabulary)
            texts.append(" ".join(copy) + (" " + passage if rnd.random() < 0.3 else ""))
    rows = [(i, t) for i, t in enumerate(texts)]
    rnd.shuffle(rows)
    sets = {i: shingle_set(t) for i, t in rows}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    want = closure(sets, links)
    docs = spark.createDataFrame([(*r, 5, "x") for r in rows], "doc_id long, text string, n_shingles int, token string").repartition(4)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.linked_rows(docs).collect()}
    assert got == {i: (len(sets[i]), want[i]) for i in sets}
    kept = jaccard.keep_first(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted(i for i in want if want[i] == i)


def linked(docs):
    """component_id by doc_id, by all pairs."""
    sets = {i: shingle_set(t) for i, t in docs}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    return closure(sets, links)


def test_jaccard_join_of_a_boilerplate_chain(spark, monkeypatch):
    """Short texts of two neighbouring passages each: a chain ties hundreds of them, of which few link."""
    monkeypatch.setattr(jaccard, "CHUNK", 16)
    monkeypatch.setattr(jaccard_postings, "BUCKET_BYTES", 512)
    monkeypatch.setattr(jaccard_postings, "FAN", 3)  # so that shingles are dealt out in two passes
    rnd = random.Random(6)
    passages = [" ".join(f"p{k}x{j}" for j in range(rnd.choice([9, 12, 14]))) for k in range(60)]
    texts = []
    for k in range(60):
        for _ in range(6):
            tail = "" if rnd.random() < 0.3 else " " + " ".join(f"t{rnd.randrange(10)}" for _ in range(rnd.choice([1, 2, 5])))
            texts.append(f"{passages[k]} {passages[(k + 1) % 60]}{tail}" if rnd.random() < 0.8 else f"{passages[k]}{tail}")
    rows = list(enumerate(texts))
    want = linked(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert {r.doc_id: r.component_id for r in jaccard.linked_rows(docs).collect()} == want
    assert len(set(want.values())) > 100


def test_jaccard_join_of_a_very_long_text(spark):
    rnd = random.Random(8)
    words = [f"w{rnd.randrange(5000)}" for _ in range(120_000)]
    near = list(words)
    for _ in range(2000):
        near[rnd.randrange(len(near))] = "changed"
    rows = [(4, " ".join(words)), (2, " ".join(near)), (3, " ".join(words[:60_000])), (1, "a b c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in jaccard.linked_rows(docs).collect()} == {1: 1, 2: 2, 3: 3, 4: 2}


def test_packed_shingles_return():
    rng = np.random.default_rng(4)
    for n, homes in ((0, 1), (500, 7), (100_000, 900)):
        tokens, home, own = rng.integers(0, 1 << 48, n), rng.integers(0, homes, n), rng.integers(0, 60_000, n)
        names, often, often_home, counts = rng.integers(0, 1 << 60, homes), rng.integers(0, 1 << 48, 5), rng.integers(0, homes, 5), rng.integers(17, 99, 5)
        sent, got = jaccard_postings.Postings(), jaccard_postings.Postings()
        sent.add(tokens, home, own, names, often, often_home, counts)
        dests = []
        for batch in jaccard_postings._sent(sent.taken(), 11):
            dests += batch.column("dest").to_pylist()
            for data in batch.column("packed"):
                got.add_packed(data.as_py())
        t, h, o, m, f, fh, c = got.taken()
        assert len(set(dests)) == len(dests) <= 11
        assert sorted(zip(t, m[h] if n else [], o, strict=True)) == sorted(zip(tokens, names[home], own, strict=True))
        assert sorted(zip(f, m[fh], c, strict=True)) == sorted(zip(often, names[often_home], counts, strict=True))


def test_jaccard_join_of_odd_tables(spark):
    text = "p q r s t u v w x y z"
    docs = spark.createDataFrame([(1, text), (1, text), (None, text), (2, None), (None, None)], "doc_id long, text string")
    assert sorted(map(tuple, jaccard.linked_rows(docs).collect()), key=repr) == [(1, 7, 1), (1, 7, 1), (2, 0, 2), (None, 0, None), (None, 7, 1)]
    assert jaccard.linked_rows(docs.limit(0)).collect() == []


def test_one_row_of_each_group_stays(spark):
    text, near, other = (" ".join(f"{c}{i}" for i in range(40)) for c in "aab")
    near += " end"
    rows = [(3, text), (3, text), (3, near), (5, text), (None, text), (None, text), (9, other), (3, other), (None, "one two"), (None, "one two"), (7, None), (7, None), (None, None), (8, "x y"), (8, "x y")]
    docs = spark.createDataFrame([(*r, i % 2) for i, r in enumerate(rows)], "doc_id long, text string, position int").repartition(3)
    kept = jaccard.keep_first(docs)
    assert kept.columns == docs.columns
    got = [(r.doc_id, r.text) for r in kept.collect()]
    assert sum(t in (text, near) for _, t in got) == 1 and all(i == 3 for i, t in got if t in (text, near))
    rest = sorted((r for r in got if r[1] not in (text, near)), key=repr)
    assert rest == sorted([(3, other), (None, "one two"), (7, None), (7, None), (None, None), (8, "x y")], key=repr)
    assert jaccard.keep_first(docs.limit(0)).collect() == []


def test_near_vectors_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(near_vectors, "CHUNK", 16)
    rng = np.random.default_rng(3)
    rows, n = [], 0
    for label in (0, 1):
        for _ in range(40):
            centre = rng.normal(size=32)
            for _ in range(rng.choice([1, 1, 3, 40])):
                rows.append((n, [float(x) for x in (centre + rng.normal(size=32) * 0.1).astype(np.float32)], label))
                n += 1
    rows += [(n + i, rows[i][1], rows[i][2]) for i in range(5)]  # exact copies
    n += 5
    good = list(rows)
    odd = [(n, None, 0), (n + 1, [0.0] * 32, 0), (n + 2, [float("nan")] + [1.0] * 31, 0), (n + 3, rows[0][1], None), (n + 4, [], 0), (n + 5, [1.0, None], 0)]
    short = [(n + 6, [1.0, 0.0], 0), (n + 7, [1.0, 0.001], 0)]
    x, lab = np.array([r[1] for r in good]), np.array([r[2] for r in good])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    link = (x @ x.T >= 0.98) & (lab[:, None] == lab[None]) & ~np.eye(len(x), dtype=bool)
    pairs = [(int(a), int(b)) for a, b in zip(*np.nonzero(link), strict=True)] + [(n + 6, n + 7)]
    want = closure([r[0] for r in rows + odd + short], pairs)
    v = spark.createDataFrame(rows + odd + short, "vec_id long, embedding array<float>, label int").repartition(3)
    got = {r.vec_id: r for r in near_vectors.near_duplicates(v.withColumn("class", F.lit(1)), near_vectors.Settings(rows_a_list=20)).collect()}
    assert len(got) == n + 8
    found = sum(got[r[0]].n_links for r in good)
    assert found <= link.sum() and found >= 0.99 * link.sum()
    assert all(got[r[0]].n_links == 0 and got[r[0]].kept for r in odd)
    assert got[n + 7].component_id == n + 6 and got[n + 7].n_links == 1
    assert sum(got[i].component_id == want[i] for i in want) >= 0.99 * len(want)
    assert near_vectors.near_duplicates(v.limit(0)).collect() == []


def test_near_vectors_of_low_dimension_lose_no_link(spark, monkeypatch):
    """Links that cross the borders of lists are found, and counted at both ends, at any number of lists."""
    monkeypatch.setattr(near_vectors, "CHUNK", 64)
    rng, parts = np.random.default_rng(4), []
    for dim, n in ((4, 900), (8, 900)):
        x = rng.normal(size=(n, dim)) @ rng.normal(size=(dim, 64))
        parts.append(x / np.linalg.norm(x, axis=1, keepdims=True))
        parts.append(parts[-1][: n // 4] + rng.normal(size=(n // 4, 64)) * 0.015)
    x = np.concatenate(parts).astype(np.float32).astype(float)
    lab = rng.integers(0, 2, len(x))
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    link = (u @ u.T >= 0.98) & (lab[:, None] == lab[None]) & ~np.eye(len(x), dtype=bool)
    assert link.sum() > 1000
    want = closure(range(len(x)), [(int(a), int(b)) for a, b in zip(*np.nonzero(link), strict=True)])
    v = spark.createDataFrame([(i, [float(c) for c in r], int(k)) for i, (r, k) in enumerate(zip(x, lab, strict=True))], "vec_id long, embedding array<float>, label int").repartition(3)
    for rows_a_list in (8, 100):
        got = {r.vec_id: (r.n_links, r.component_id) for r in near_vectors.near_duplicates(v, near_vectors.Settings(rows_a_list=rows_a_list)).collect()}
        assert got == {i: (int(link[i].sum()), want[i]) for i in range(len(x))}


def test_near_vectors_count_a_pair_at_both_ends(spark, monkeypatch):
    monkeypatch.setattr(near_vectors, "CHUNK", 64)
    rng = np.random.default_rng(6)
    base = rng.normal(size=(700, 6)) @ rng.normal(size=(6, 64))
    x = np.concatenate([base, base + rng.normal(size=base.shape) * 0.18 * np.linalg.norm(base, axis=1, keepdims=True) / 8])
    lab = np.tile(np.arange(700), 2)  # so that nothing but the two of a pair can link
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    linked = (u[:700] * u[700:]).sum(1) >= 0.98
    assert linked.sum() > 300
    lab = np.where(np.tile(np.arange(700), 2) < 350, lab, 1000)
    v = spark.createDataFrame([(i, [float(c) for c in r], int(k)) for i, (r, k) in enumerate(zip(x, lab, strict=True))], "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: r.n_links for r in near_vectors.near_duplicates(v, near_vectors.Settings(rows_a_list=8)).collect()}
    assert all(got[i] == got[i + 700] == linked[i] for i in range(350))
    link = u @ u.T >= 0.98
    assert all(got[i] == (link[i] & (lab == 1000)).sum() - 1 for i in range(1400) if lab[i] == 1000)


def test_near_vectors_recall_at_most_lists(spark):
    """Clusters of differing density and data of 4 and 8 dimensions, with links, at the 1024 lists of large tables."""
    rng, parts = np.random.default_rng(8), []
    for dim in (4, 8):
        parts.append(rng.normal(size=(2600, dim)) @ rng.normal(size=(dim, 32)))
    for n in (1, 2, 10, 60, 300):
        for spread in (0.05, 0.1, 0.14):
            parts += [rng.normal(size=32) + rng.normal(size=(n, 32)) * spread for _ in range(600 // n if n > 2 else 120)]
    x = np.concatenate([p / np.linalg.norm(p, axis=1, keepdims=True) for p in parts]).astype(np.float32).astype(float)
    assert len(x) // 8 >= 1024
    lab = rng.integers(0, 2, len(x))
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    link = (u @ u.T >= 0.98) & (lab[:, None] == lab[None]) & ~np.eye(len(x), dtype=bool)
    assert link[:5200].sum() > 1000 and link[5200:].sum() > 1000
    v = spark.createDataFrame([(i, r.tolist(), int(k)) for i, (r, k) in enumerate(zip(x, lab, strict=True))], "vec_id long, embedding array<float>, label int").repartition(4)
    got = {r.vec_id: r.n_links for r in near_vectors.near_duplicates(v, near_vectors.Settings(rows_a_list=8)).select("vec_id", "n_links").collect()}
    assert [got[i] for i in range(len(x))] == link.sum(1).tolist()


def test_snapshots_collapse(spark):
    turns = lambda c, n, end="": [(c, i, "user" if i % 2 == 0 else "assistant", f"t{i}{end if i == n - 1 else ''}") for i in range(n)]
    rows = turns(1, 2) + turns(2, 4) + turns(3, 3) + turns(4, 3, "!") + turns(5, 4) + [(6, 0, None, None), (6, 0, None, None), (None, 1, "user", "lonely")]
    df = spark.createDataFrame([(*r, 9) for r in rows], "conv_id long, turn long, role string, text string, position int")
    got = {r.conv_id: (r.n_turns, r.n_snapshots, r.rendered) for r in chat.collapse(df).collect()}
    assert set(got) == {2, 4, 6, None}
    assert got[2][:2] == (4, 2) and got[4][0] == 3
    assert got[6] == (1, 1, "<|im_start|>unknown\n<|im_end|>\n") and got[None][2] == "<|im_start|>user\nlonely<|im_end|>\n"
    assert chat.collapse(df.limit(0)).collect() == []


def test_rows_travel_to_the_bucket_that_they_name():
    """Whatever the order in which a task gets its rows, each goes to the same bucket, and buckets fill evenly."""
    from volpanel.llm.jaccard_postings import bucket_of

    rng = np.random.default_rng(1)
    home, doc, sets = rng.integers(0, 1 << 40, 5000), rng.integers(-5, 1 << 40, 5000), rng.integers(-(1 << 63), (1 << 63) - 1, 5000)
    order = rng.permutation(5000)
    assert (bucket_of(50, home, doc, sets)[order] == bucket_of(50, home[order], doc[order], sets[order])).all()
    assert np.bincount(bucket_of(50, home, doc, sets), minlength=50).min() > 50
    same = bucket_of(50, rng.integers(0, 1 << 40, 5000), 0, 7)  # one text without an id, met by many holders
    assert np.bincount(same, minlength=50).min() > 50 and ((same >= 0) & (same < 50)).all()


def test_second_dealing_in_any_order(spark, monkeypatch):
    """The second pass sends rows of two orders to the same buckets; nothing is lost or doubled, and documents from a shuffle are read once."""
    from volpanel.llm import jaccard, jaccard_postings

    monkeypatch.setattr(jaccard_postings, "FAN", 2)
    monkeypatch.setattr(jaccard_postings, "BUCKET_BYTES", 400)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").limit(120)
    want = sorted(map(tuple, jaccard.linked_rows(docs.orderBy("doc_id")).collect()))
    assert len(want) == 120 and want == sorted(map(tuple, jaccard.linked_rows(docs.repartition(5, "text")).collect()))
    rows = jaccard_postings._dealt(docs.withColumn("mark", F.lit(None).cast("binary")), 0, 5, 2).where(F.col("kind") == jaccard_postings.DOCUMENT)
    place = lambda df: sorted((r.doc_id, r.dest) for r in jaccard_postings._dealt_again(df, 40).collect())
    rows = rows.persist()
    assert place(rows.orderBy("doc_id")) == place(rows.orderBy(F.desc("doc_id")))


def test_jaccard_leaves_the_tables_that_it_reads(spark):
    """Of all stored steps two are left: the documents' rows and the names of sets."""
    import os

    from volpanel.llm import common, jaccard

    folder = common.shared_folder(spark).removeprefix("file:")
    before = set(os.listdir(folder))
    found = jaccard.linked_rows(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    left = set(os.listdir(folder)) - before
    assert len(left) == 2 and found.count() == 1000, left


def test_vectors_without_an_id_link_with_nothing(spark):
    x = [[1.0, 0.0], [1.0, 0.01], [1.0, 0.02]]
    df = spark.createDataFrame([(None, x[0], 1), (1, x[1], 1), (2, x[2], 1), (None, x[0], 1)], "vec_id long, embedding array<float>, label int")
    got = sorted(((r.vec_id, r.n_links) for r in near_vectors.near_duplicates(df).collect()), key=repr)
    assert got == [(1, 1), (2, 1), (None, 0), (None, 0)]


def test_long_conversations_and_null_ids(spark):
    """A conversation of 3,000 turns, its snapshot of 2,000, and rows without an id, which are one conversation of their own."""
    turns = [(t, "user", f"turn {t}") for t in range(3000)]
    rows = [(1, *t) for t in turns] + [(2, *t) for t in turns[:2000]] + [(None, *t) for t in turns[:500]] + [(None, 9000, "user", "other")]
    got = {r.conv_id: (r.n_turns, r.n_snapshots, len(r.rendered)) for r in chat.collapse(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    size = lambda ts: sum(len(f"<|im_start|>{r}\n{x}<|im_end|>\n") for _, r, x in ts)
    assert got == {1: (3000, 1, size(turns)), None: (501, 1, size([*turns[:500], (0, "user", "other")]))}
