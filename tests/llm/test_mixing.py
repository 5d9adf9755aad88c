"""Operator 13 against plain sums, its own mix, and brute force over small draws."""

import math
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from volpanel.llm import mixing, queries_mixing

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_targets(sizes, most=3):
    """The rule step by step: {source: words} to {source: target}, null last."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(order)}
    held, total = {}, float(sum(sizes.values()))
    while True:
        free = [s for s in order if s not in held]
        left, all_weights = total - sum(held.values()), sum(weight[s] for s in free)
        share = {s: left * weight[s] / all_weights for s in free}
        over = [s for s in free if share[s] > most * sizes[s]]
        if not over:
            return held | share
        held |= {s: float(most * sizes[s]) for s in over}


def check(docs, settings=mixing.Settings()):
    given = docs.select("doc_id", "source", "text").collect()
    rows = mixing.taken_rows(docs, settings).collect()
    assert Counter(r.doc_id for r in rows) == Counter(r.doc_id for r in given)
    sizes = defaultdict(int)
    for r in given:
        sizes[r.source] += len(WORD.findall(r.text or ""))
    assert Counter((r.doc_id, r.size) for r in rows) == Counter((r.doc_id, len(WORD.findall(r.text or ""))) for r in given)
    want = plain_targets(sizes, settings.most_epochs) if sizes else {}
    source_of = {r.doc_id: r.source for r in given}
    taken = defaultdict(int)
    for r in rows:
        s = source_of[r.doc_id]
        assert r.source_size == sizes[s] and math.isclose(r.target, want[s], rel_tol=1e-9, abs_tol=1e-9)
        times = want[s] / sizes[s] if sizes[s] else 0
        assert math.floor(times - 1e-9) * r.size <= r.taken <= min(math.ceil(times + 1e-9), settings.most_epochs) * r.size
        taken[s] += r.taken
    assert all(abs(taken[s] - want[s]) <= 1 for s in sizes)
    return rows


def test_query(spark):
    rows = check(spark.read.parquet(f"{SF}/documents.parquet"))
    again = queries_mixing.op13_mix_sources(spark, SF)
    assert again.dtypes == [("doc_id", "bigint"), ("size", "bigint"), ("source_size", "bigint"), ("target", "double"), ("taken", "bigint")]
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, rows))


@pytest.fixture
def odd(spark):
    """Null source, id and text, repeated rows, one source of nearly all words, tiny sources that stop, a long text."""
    rows = [(i, "b", f"w{i} x  y\n") for i in range(40)] + [(100 + i, "é", "one") for i in range(3)] + [(None, None, "p q r")] * 5 + [(7, "b", "same again")] * 4
    rows += [(200, "a", None), (201, "a", ""), (202, "zz", " \t\n"), (300, "Z", " ".join(map(str, range(5000)))), (301, "Z", " lead and  trail \n")]
    return spark.createDataFrame(rows, "doc_id long, source string, text string").withColumn("words", F.lit(1)).withColumn("number", F.lit("x"))


@pytest.mark.parametrize("block,shard", [(4096, 64), (7, 3), (1, 50)])
def test_odd_rows(odd, block, shard):
    check(odd.where("doc_id IS NOT NULL AND doc_id <> 7"), mixing.Settings(block_words=block, blocks_a_shard=shard))
    rows = mixing.taken_rows(odd, mixing.Settings(block_words=block, blocks_a_shard=shard)).collect()
    assert Counter(r.doc_id for r in rows)[None] == 5 and Counter(r.doc_id for r in rows)[7] == 5
    assert all(r.taken <= 3 * r.size for r in rows)
    moved = mixing.taken_rows(odd.repartition(3, "text"), mixing.Settings(block_words=block, blocks_a_shard=shard)).collect()
    assert Counter(map(tuple, rows)) == Counter(map(tuple, moved))


def test_empty(spark):
    assert mixing.taken_rows(spark.createDataFrame([], "doc_id long, source string, text string")).isEmpty()
    assert mixing.taken_rows(spark.createDataFrame([(1, "a", None)], "doc_id long, source string, text string")).collect()[0].taken == 0


def test_mix_is_what_the_rows_say(odd):
    """Shards are of like size, pieces of an epoch never overlap, and texts are the words that were taken."""
    settings = mixing.Settings(block_words=7, blocks_a_shard=3)
    docs = odd.where("doc_id IS NOT NULL AND doc_id <> 7")
    text = {r.doc_id: r.text for r in docs.collect()}
    pieces, seen, taken = mixing.mixed(docs, settings).collect(), set(), Counter()
    for p in pieces:
        assert p.text.split() == WORD.findall(text[p.doc_id])[p.first : p.first + p.n] and p.text in text[p.doc_id]
        for w in range(p.first, p.first + p.n):
            assert (p.doc_id, p.epoch, w) not in seen
            seen.add((p.doc_id, p.epoch, w))
        taken[p.doc_id] += p.n
    assert taken == Counter({r.doc_id: r.taken for r in mixing.taken_rows(docs, settings).collect() if r.taken})
    places = defaultdict(list)
    for p in pieces:
        places[p.shard].append(p.place)
    assert all(sorted(x) == list(range(1, len(x) + 1)) for x in places.values())
    draws = mixing.planned(docs, settings).draws
    per = [r["count"] for r in draws.groupBy("shard").count().collect()]
    assert set(per) <= {2, 3} and draws.select("number", "draw").distinct().count() == sum(per) == draws.select("number", "epoch", "block").distinct().count()


def test_draws_are_hypergeometric(spark):
    """20,000 draws of 12 out of 50 with 20 good ones: each frequency within five deviations of its probability."""
    n = 20_000
    x = F.col("id")
    found = Counter(int(r[0]) for r in spark.range(n).select(mixing.hypergeometric(F.lit(50.0), F.lit(20.0), F.lit(12.0), mixing.uniform(1, x))).collect())
    for k in range(13):
        p = math.comb(20, k) * math.comb(30, 12 - k) / math.comb(50, 12)
        assert abs(found[k] - n * p) <= 5 * math.sqrt(n * p * (1 - p)) + 1
    edges = spark.range(50).select(mixing.hypergeometric(x + 1, x + 1, F.lit(1.0), mixing.uniform(2, x)), mixing.hypergeometric(x + 1, F.lit(0.0), x + 1, mixing.uniform(3, x))).collect()
    assert {tuple(r) for r in edges} == {(1.0, 0.0)}


def test_permutation(spark):
    rows = spark.range(997).select("id", mixing.permuted(F.col("id"), F.lit(997), 5, F.lit(2)).alias("y")).withColumn("back", mixing.permuted(F.col("y"), F.lit(997), 5, F.lit(2), back=True)).collect()
    assert sorted(r.y for r in rows) == list(range(997)) and all(r.back == r.id for r in rows) and sum(r.y == r.id for r in rows) < 10
