"""Null and shared ids, equal vectors, vectors of several lengths, and the pipeline's stages against plain versions."""

import itertools
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from crawlspark.llm import mixing, near_dup, nearest, vector_dup

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, key string, _row string, id long, place int, extra_key int, _place int"


def frame(spark, rows):
    """Documents from (doc_id, text, source) with columns named like the operators' own."""
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), -1, "k", "r", 5, 6, 7, 8) for i, t, s in rows], SCHEMA).repartition(3)


def words(n, rng):
    return " ".join(rng.choice("abcdefgh") * rng.randint(1, 4) for _ in range(n))


@pytest.mark.parametrize("ids", ["none", "one", "half", "equal rows"])
def test_rows_without_an_id_of_their_own_reach_their_target(spark, ids):
    rng = random.Random(3)
    rows = [(i, words(10, rng), "a") for i in range(800)]
    for k in range(1500):
        doc_id = {"none": None, "one": 7, "half": None if k % 2 else 1000 + k, "equal rows": 9}[ids]
        rows.append((doc_id, "the same ten words in a row for all rows" if ids == "equal rows" else words(rng.randint(5, 15), rng), "b"))
    rows += [(i, words(400, rng), "c") for i in range(5000, 5030)]
    got = mixing.draws(frame(spark, rows)).collect()
    taken, target, largest = Counter(), {}, Counter()
    for r in got:
        taken[r.source] += r.taken
        target[r.source] = r.target
        largest[r.source] = max(largest[r.source], r.size)
        assert r.taken <= 3 * r.size
    assert all(abs(taken[s] - target[s]) <= largest[s] for s in target)
    copies = [len(r.shards) for r in got if r.source == "b"]
    assert max(copies) - min(copies) <= 1
    if ids != "equal rows":
        again = mixing.draws(frame(spark, rows).repartition(5)).collect()
        assert Counter((r.doc_id, r.text, tuple(r.shards)) for r in again) == Counter((r.doc_id, r.text, tuple(r.shards)) for r in got)


def test_mix_keeps_the_columns_it_was_given(spark):
    rows = [(i, words(9, random.Random(i)), "ab"[i % 2]) for i in range(60)] + [(None, None, None)]
    docs = frame(spark, rows)
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    drawn = Counter({r.doc_id: len(r.shards) for r in mixing.draws(docs).collect()})
    found = mixed.collect()
    assert Counter(r.doc_id for r in found) == +drawn
    assert {(r.size, r.key, r._row, r.id, r.place, r.extra_key, r._place) for r in found} == {(-1, "k", "r", 5, 6, 7, 8)}


def shingles(text):
    w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) > 4 else {tuple(w)} - {()}


def plain_kept(rows):
    """Texts that stay with their ids: one of each group, the smallest id first, and all without words."""
    texts = sorted({t for _, t, *_ in rows if shingles(t)})
    sets, root = {t: shingles(t) for t in texts}, {t: t for t in texts}

    def find(t):
        while root[t] != t:
            t = root[t]
        return t

    for x, y in itertools.combinations(texts, 2):
        if 100 * len(sets[x] & sets[y]) >= 75 * len(sets[x] | sets[y]):
            root[find(x)] = find(y)
    groups = defaultdict(list)
    for i, t, *_ in rows:
        if shingles(t):
            groups[find(t)].append((i is None, i or 0, t))
    return groups, Counter((i, t) for i, t, *_ in rows if not shingles(t))


def test_one_row_of_each_group_stays_and_no_unique_text_goes(spark):
    rng = random.Random(5)
    base = [words(60, rng) for _ in range(4)]
    near = [t + " end" for t in base]
    rows = [(1, base[0], "s"), (2, base[0], "s"), (2, words(30, rng), "s"), (5, base[1], "s"), (5, base[1], "s"), (None, base[2], "s"), (None, base[2], "s")]
    rows += [(9, near[2], "s"), (None, near[3], "s"), (None, base[3], "s"), (3, None, "s"), (3, "", "s"), (None, " ", "s"), (4, "two words", "s"), (4, "two words", "s")]
    got = near_dup.kept_documents(frame(spark, rows))
    assert got.columns == frame(spark, rows).columns
    kept = Counter((r.doc_id, r.text) for r in got.collect())
    groups, empty = plain_kept(rows)
    assert {k: n for k, n in kept.items() if not shingles(k[1])} == dict(empty)
    kept = {k: n for k, n in kept.items() if shingles(k[1])}
    assert set(kept.values()) == {1} and len(kept) == len(groups)
    for members in groups.values():
        least = min(m[:2] for m in members)
        mine = [(i, t) for i, t in kept if (i is None, i or 0, t) in members]
        assert len(mine) == 1 and (mine[0][0] is None, mine[0][0] or 0) == least
    unique = [(i, t, "s") for i, t in enumerate(base + near)]
    assert sorted(r.doc_id for r in near_dup.kept_documents(frame(spark, unique)).collect()) == [0, 1, 2, 3]


VECTORS = "vec_id long, embedding array<double>, cell long, part long, id long, n int"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, -1, -1, -1, -1) for i, v in rows], VECTORS).repartition(3)


def test_equal_vectors_rank_by_id_and_only_equal_lengths_meet(spark):
    rng = np.random.default_rng(4)
    same = rng.standard_normal(8).tolist()
    rows = [(1000 + k, same) for k in range(400)] + [(k, rng.standard_normal(8).tolist()) for k in range(100)]
    rows += [(2000 + k, [1.0, 2.0, 3.0]) for k in range(5)] + [(2010, [-3.0, 0.0, 1.0]), (2020, [5.0])]
    got = nearest.nearest(vectors(spark, rows), F.col("vec_id") % 20 == 0, block=64).collect()
    by = defaultdict(list)
    for r in sorted(got, key=lambda r: r.rank):
        by[r.query_id].append((r.vec_id, r.score))
    kept = {i: np.array(v) for i, v in rows}
    for i in [i for i in kept if i % 20 == 0]:
        x = kept[i]
        score = {j: float((x * y).sum() / np.sqrt((x * x).sum() * (y * y).sum())) for j, y in kept.items() if j != i and len(y) == len(x)}
        want = sorted(score, key=lambda j: (-round(score[j], 12), j))[:5]
        assert [j for j, _ in by[i]] == want
        assert all(abs(s - score[j]) < 1e-12 for j, s in by[i])
    dup = {r.vec_id: r for r in vector_dup.near_duplicates(vectors(spark, rows), tile=64).collect()}
    assert {dup[1000 + k].n_links for k in range(400)} == {399} and {dup[2000 + k].n_links for k in range(5)} == {4}
    assert dup[2020].n_links == 0 and dup[2004].component_id == 2000 and dup[1399].component_id == 1000


def test_pipeline_stages_against_plain_versions(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    odd = [(None, "no id at all", "en", "odd", 12), (1, "shares its id with another text", "en", "odd", 31), (10**6, None, "en", None, 0), (10**6 + 1, "", None, "odd", 0)]
    docs = docs.unionByName(spark.createDataFrame(odd, docs.schema))
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "near_dedup", "mixing", "packing"]
    toxic = {r.doc_id: r.toxic for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}

    clean = stages["toxicity"](spark, docs, folder)
    assert clean.columns == corpus_pipeline.COLUMNS
    clean = clean.collect()
    left = {r.doc_id for r in clean}
    given = Counter((r.doc_id, r.text) for r in docs.collect())
    assert not Counter((r.doc_id, r.text) for r in clean) - given
    judged = [(toxic[i], i in left) for i, _ in given if i in toxic and i != 1]
    assert np.mean([stays != bool(t) for t, stays in judged]) > 0.95

    kept = stages["near_dedup"](spark, spark.createDataFrame(clean, docs.schema), folder)
    assert kept.columns == corpus_pipeline.COLUMNS
    kept = kept.collect()
    groups, empty = plain_kept([(r.doc_id, r.text) for r in clean])
    assert Counter(r.doc_id for r in kept) == Counter([min(m)[1] if not min(m)[0] else None for m in groups.values()] + [i for i, _ in empty.elements()])

    mixed = stages["mixing"](spark, spark.createDataFrame(kept, docs.schema), folder)
    assert mixed.columns == corpus_pipeline.COLUMNS
    mixed = mixed.collect()
    times = Counter((r.doc_id, r.text) for r in mixed)
    assert set(times) <= {(r.doc_id, r.text) for r in kept} and max(times.values()) <= 3
    sizes, sources = Counter(), sorted({r.source for r in kept}, key=lambda s: (s is None, s or ""))
    for r in kept:
        sizes[r.source] += len((r.text or "").split())
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(sources)}
    total, capped = sum(sizes.values()), {}
    while True:
        open_ = [s for s in sources if s not in capped]
        share = (total - sum(capped.values())) / max(1, sum(weight[s] for s in open_))
        above = {s: 3 * sizes[s] for s in open_ if share * weight[s] > 3 * sizes[s]}
        if not above:
            break
        capped |= above
    taken = Counter()
    for r in mixed:
        taken[r.source] += len((r.text or "").split())
    for s in sources:
        longest = max(len((r.text or "").split()) for r in kept if r.source == s)
        assert abs(taken[s] - capped.get(s, share * weight[s])) <= longest

    pieces = stages["packing"](spark, spark.createDataFrame(mixed, docs.schema), folder).collect()
    by, lines = defaultdict(list), defaultdict(list)
    for p in pieces:
        by[p.doc_id].append(p)
        lines[p.sequence_id].append(p)
    assert Counter({i: sum(p.start == 0 for p in ps) for i, ps in by.items()}) == Counter(r.doc_id for r in mixed)
    assert all(sum(p.length for p in ps) == sum(p.doc_tokens for p in ps if p.start == 0) for ps in by.values())
    for ps in lines.values():
        ps.sort(key=lambda p: p.offset)
        assert [p.offset for p in ps] == [sum(q.length for q in ps[:k]) for k in range(len(ps))] and sum(p.length for p in ps) <= 2048
    assert sum(1 for _ in corpus_pipeline.run(spark, folder).toLocalIterator()) > 0
