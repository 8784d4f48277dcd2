"""Operators over documents against plain versions, and on nulls, empty, long, tied, repeated rows and clashing columns."""

import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

import public_tokenizers
from crawlspark.llm import mixing, near_dup, packing, toxicity, training_order
from crawlspark.llm.tokens import token_ids

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, a string, b string, key string, size long, cell int"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def frame(spark, rows):
    """Documents from (doc_id, text, source), with columns named like the operators' own."""
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), "a", "b", "k", -1, 3) for i, t, s in rows], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def odd():
    rng = random.Random(3)
    words = [f"w{k}" for k in range(300)]
    base = [rng.choice(words) for _ in range(80)]
    rows = [(k, " ".join(base[:j] + [f"x{k}"] + base[j + 1 :]), "s1") for k, j in enumerate(range(0, 80, 8))]
    rows += [(20 + k, " ".join(rng.choice(words) for _ in range(60)), "s2") for k in range(12)]
    rows += [(40, None, None), (41, "", "s3"), (42, " \t\n ", "s3"), (43, "one two", "s3"), (44, "ONE  two", None), (None, "one two", "s2"), (None, None, None)]
    rows += [(45, " ".join(base), "s1"), (45, " ".join(base), "s1"), (46, " ".join(rng.choice(words) for _ in range(30_000)), "s4"), (47, "a.b" * 3000, "s4")]
    return rows


def shingles(text):
    w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) > 4 else {tuple(w)} - {()}


def test_near_duplicates_equal_brute_force(spark, odd):
    sets = [(i, shingles(t)) for i, t, _ in odd]
    root = {i: i for i, _ in sets if i is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for (i, x), (j, y) in itertools.combinations(sets, 2):
        if None not in (i, j) and x and y and 100 * len(x & y) >= 75 * len(x | y):
            a, b = sorted((find(i), find(j)))
            root[b] = a
    want = Counter((i, len(s), find(i) if i is not None else None, i is None or find(i) == i) for i, s in sets)
    got = Counter(tuple(r) for r in near_dup.near_duplicates(frame(spark, odd)).collect())
    assert got == want
    kept = near_dup.kept_documents(frame(spark, odd))
    assert kept.columns == SCHEMA.replace(",", "").split()[::2]
    # the copy of document 43 that has no id goes too
    assert sum(1 for _ in kept.toLocalIterator()) == sum(n for r, n in want.items() if r[3]) - 1
    assert (None, "one two") not in {(r.doc_id, r.text) for r in kept.collect()}


def test_hot_bucket_in_tiles(spark, monkeypatch):
    monkeypatch.setattr(near_dup, "TILE", 8)
    rng = random.Random(5)
    base = [f"w{k}" for k in range(60)]
    rows = [(k, " ".join(w if rng.random() > 0.004 * (k % 9) else f"z{k}" for w in base), "s") for k in range(60)]
    sets = {i: shingles(t) for i, t, _ in rows}
    root = {i: i for i in sets}
    for _ in range(60):
        for i, j in itertools.combinations(sets, 2):
            if 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                root[i] = root[j] = min(root[i], root[j])
    got = {r.doc_id: r.component_id for r in near_dup.near_duplicates(frame(spark, rows)).collect()}
    assert got == root


def test_mix_reaches_targets(spark, odd):
    rng = random.Random(1)
    rows = odd + [(1000 + k, "x " * rng.randrange(40), f"t{k % 7}") for k in range(400)]
    got = mixing.draws(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    sizes, taken, target = Counter(), Counter(), {}
    for r in got:
        assert r["size"] == len(WORD.findall(r.text or ""))
        assert r.taken == r["size"] * len(r.shards) and len(r.shards) <= 3
        sizes[r.source] += r["size"]
        taken[r.source] += r.taken
        target[r.source] = r.target
    order = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    capped = set()
    while True:
        rest = sum(sizes.values()) - sum(3 * sizes[s] for s in capped)
        open_ = [s for s in order if s not in capped]
        want = {s: 3.0 * sizes[s] if s in capped else rest * weight[s] / sum(weight[x] for x in open_) for s in order}
        over = {s for s in open_ if want[s] > 3 * sizes[s]}
        if not over:
            break
        capped |= over
    for s in order:
        assert target[s] == pytest.approx(want[s])
        assert all(r.source_size == sizes[s] for r in got if r.source == s)
        if s and s[0] == "t":
            assert abs(taken[s] - want[s]) <= 40
    again = mixing.draws(frame(spark, rows).repartition(5)).collect()
    assert Counter((r.doc_id, r.taken, tuple(r.shards)) for r in got) == Counter((r.doc_id, r.taken, tuple(r.shards)) for r in again)
    mixed = Counter(r.doc_id for r in mixing.mix(frame(spark, rows)).collect())
    assert mixed == Counter({i: n for i, n in _copies(got).items() if n})


def _copies(got):
    out = Counter()
    for r in got:
        out[r.doc_id] += len(r.shards)
    return out


def test_splitting_tree_keeps_quotas(spark):
    quotas = [(0, 1000), (1, 3), (2, 0), (3, 77)]
    got = mixing.shard_quotas(spark.range(1), quotas, 68, 7).collect()
    per, shards = Counter(), Counter()
    for r in got:
        per[r.place] += r.quota
        shards[r.shard] += r.quota
    assert per == Counter({p: q for p, q in quotas if q}) and max(shards.values()) <= 16 and len(shards) == 68


def pieces_of(rows, pieces):
    ids = defaultdict(list)
    for i, t, _ in rows:
        ids[i].append(token_ids(t))
    sequences = defaultdict(list)
    for p in pieces:
        sequences[p.sequence_id].append(p)
    total = 0
    for ps in sequences.values():
        at = 0
        for p in sorted(ps, key=lambda p: p.offset):
            assert p.offset == at and p.length > 0
            at += p.length
            assert any(len(x) == p.doc_tokens and zlib.crc32(x[p.start : p.start + p.length].tobytes()) == p.ids_crc32 for x in ids[p.doc_id])
        assert at <= 2048
        total += at
    assert total == sum(len(x) for xs in ids.values() for x in xs)
    padding = sum(0 if n & (n - 1) == 0 else 2048 - n for n in (sum(p.length for p in ps) for ps in sequences.values()))
    return padding, total


def test_packing_covers_every_id(spark, odd):
    pieces = packing.pack(frame(spark, odd)).collect()
    pieces_of(odd, pieces)
    whole = packing.pack(frame(spark, odd).coalesce(1), with_ids=True).collect()
    assert all(zlib.crc32(np.array(p.ids, "<u4").tobytes()) == p.ids_crc32 for p in whole)
    padding, total = pieces_of(odd, whole)
    assert padding < 0.05 * total


def test_cuts_are_the_cheapest():
    rng = np.random.default_rng(2)
    for _ in range(30):
        places = np.concatenate([[0], np.cumsum(rng.integers(1, 9, 12))])
        penalties = np.concatenate([[0], rng.integers(0, 6, 12)])
        cost = [0]
        for j in range(1, len(places)):
            gaps = [(places[j] - places[i], cost[i]) for i in range(j) if places[j] - places[i] <= 16]
            cost.append(min(f + (0 if g in (8, 4, 2) else 16 - g) for g, f in gaps) + penalties[j])
        cuts = packing.best_cuts(places, penalties, 16)
        pen = dict(zip(places.tolist(), penalties.tolist(), strict=True))
        got = sum((0 if b - a in (8, 4, 2) else 16 - b + a) + pen[b] for a, b in itertools.pairwise(cuts))
        assert got == cost[-1]


def test_ids_are_those_of_tokenizers():
    known = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    points = [chr(c) for c in itertools.chain(range(0xD800), range(0xE000, 0x11000), range(0x1F000, 0x20000))]
    texts = ["".join(f" a{c}b{c} 1{c}\n" for c in points[k : k + 500]) for k in range(0, len(points), 500)] + ["x<|endoftext|> <|endo", "", "  \r\n\t  z"]
    for text in texts:
        assert token_ids(text)[:-1].tolist() == known.encode(text, add_special_tokens=False).ids


def test_training_order_reads_back(spark, odd):
    out, _ = training_order.materialise(frame(spark, odd), shard_sequences=8)
    got = sorted(out.collect(), key=lambda r: r.slot)
    assert [r.slot for r in got] == list(range(len(got))) and len({r.shard for r in got}) > 1
    for r in got:
        ids = training_order.read_sequences(r.path, r.byte_offset // 4096, 1)[0]
        assert zlib.crc32(ids[: r.tokens].tobytes()) == r.ids_crc32 and (ids[r.tokens :] == training_order.PADDING).all()
    assert sum(r.tokens for r in got) == sum(len(token_ids(t)) for _, t, _ in odd)


def test_slots_follow_a_plain_feistel_sort_in_ranges(spark):
    rows = [(i, "word " * (700 + 13 * i), "s") for i in range(60)]
    docs = frame(spark, rows).repartition(5)
    found = training_order.materialise(docs, shard_sequences=8)[0].collect()
    ids = np.array(sorted(r.sequence_id for r in found))
    domain = training_order.SPLITS * training_order.CAPACITY
    order = training_order.feistel(ids, domain, training_order.KEY)
    wanted = ids[np.argsort(order)]
    assert [r.sequence_id for r in sorted(found, key=lambda r: r.slot)] == list(wanted)
    assert [r.slot for r in sorted(found, key=lambda r: r.slot)] == list(range(len(ids)))
    shards = [r.shard for r in sorted(found, key=lambda r: r.slot)]
    assert shards == sorted(shards) and len(set(shards)) > 2


@pytest.mark.parametrize("size", [1, 2, 3, 1000, 4097])
def test_feistel_permutes(size):
    slots = training_order.feistel(np.arange(size), size)
    assert sorted(slots) == list(range(size))
    assert size < 1000 or (slots != training_order.feistel(np.arange(size), size, 5)).any()


def test_toxicity_on_held_out_rows(spark):
    rng = random.Random(4)
    words = [f"{a}{b}" for a in ("ba", "ko", "ti", "re", "mu") for b in ("ran", "lis", "nor", "ta")]
    rows, labels = [], []
    for k in range(900):
        text = [rng.choice(words) for _ in range(rng.randrange(20, 80))]
        toxic = k % 6 == 0
        for _ in range(3 * toxic):
            text[rng.randrange(len(text))] = rng.choice(("vraskul", "vraskend", "zoffig"))
        rows.append((k, " ".join(text), "s"))
        labels.append((k, int(toxic)))
    rows += [(5000, None, None), (5001, "", "s"), (None, "ba", "s"), (5002, "baran " * 40_000, "s"), (7, rows[7][1], "s")]
    truth = spark.createDataFrame([*labels, (None, 1), (8, None), (9, 0), (777_777, 1)], "doc_id long, toxic int")
    docs = frame(spark, rows)
    model = toxicity.train(docs, truth)
    got = toxicity.score(docs, model, "key").withColumn("fold", toxicity.fold(docs["doc_id"])).collect()
    assert len(got) == len(rows) and all(0 <= r.key <= 1 for r in got)
    held = [(r.key >= 0.5, r.doc_id % 6 == 0) for r in got if r.fold == 0 and r.doc_id is not None and r.doc_id < 900]
    assert len(held) > 100 and sum(a == b for a, b in held) >= 0.97 * len(held)
    assert all(r.fold == zlib.crc32(str(r.doc_id).encode()) % 5 for r in got if r.doc_id is not None)
    assert all(r.key < 0.5 for r in got if r.doc_id in (5000, 5001, 5002))


def test_backoff_probabilities_sum_to_one(spark):
    words = spark.createDataFrame([("abba", 5, 1), ("abc", 2, 0), ("cab", 0, 3), ("b", 1, 1)], "word string, n0 long, n1 long")
    rows = {r.run: (r.n0, r.n1) for r in toxicity.letter_runs(words).collect()}
    want = Counter()
    for word, n0, n1 in words.collect():
        padded = "^^^^" + word + "$"
        for k in range(len(word) + 1):
            want[padded[k : k + 5]] += n0 + n1
    assert {r: sum(n) for r, n in rows.items()} == dict(want)
    delta = {r.run: r.delta for r in toxicity.differences(toxicity.letter_runs(words)).collect()}
    assert delta["^^^^c"] > 0 > delta["^^^ab"] and all(np.isfinite(list(delta.values())))


def test_many_small_differences_tell_toxic_texts(spark):
    rng = random.Random(7)
    words = [a + b for a in ("ba", "ko", "ti", "re", "mu") for b in ("ran", "lis", "nor", "tas")]
    odds = [1.5 if k % 2 else 1 / 1.5 for k in range(20)]  # each word less than e times likelier
    rows = [(k, " ".join(rng.choices(words, odds if k % 2 else None, k=300)), "s") for k in range(300)]
    labels = spark.createDataFrame([(k, k % 2) for k in range(300)], "doc_id long, toxic int")
    docs = frame(spark, rows)
    got = toxicity.score(docs, toxicity.train(docs, labels), "s").withColumn("f", toxicity.fold(docs["doc_id"])).where("f = 0").collect()
    assert sum((r.s >= 0.5) == (r.doc_id % 2 == 1) for r in got) >= 0.9 * len(got) > 30


def test_scores_equal_plain_kneser_ney_and_unseen_runs_back_off(spark):
    words = spark.createDataFrame([("abba", 5, 1), ("abc", 2, 0), ("cab", 0, 3), ("b", 1, 1), ("abbc", 0, 2), ("語語文", 0, 1)], "word string, n0 long, n1 long")
    counts = {r.run: (r.n0, r.n1) for r in toxicity.letter_runs(words).collect()}

    def shared(run):
        longer = set(counts)
        for _ in range(5 - len(run)):
            longer = {r[1:] for r in longer} if len(next(iter(longer))) > len(run) + 1 else longer
        k = Counter(r[1:] for r in longer)
        if len(run) == 1:
            return k[run] / sum(k.values())
        s, t = (f(n for r, n in k.items() if r[:-1] == run[:-1]) for f in (sum, lambda x: len(list(x))))
        return max(k[run] - 0.75, 0) / s + 0.75 * t / s * shared(run[1:])

    def plain(run):
        same = [r for r in counts if r[:-1] == run[:-1]]
        logs = []
        for c in (0, 1):
            s, t = sum(counts[r][c] for r in same), sum(counts[r][c] > 0 for r in same)
            backoff = shared(run[1:]) if run in counts else 1.0  # an unseen run's own is the same in both
            own = max(counts.get(run, (0, 0))[c] - 0.75, 0)
            logs.append(np.log(own / s + 0.75 * t / s * backoff if s else backoff))
        return logs[1] - logs[0]

    scorer = toxicity.Scorer(toxicity.model_of(toxicity.letter_runs(words)))
    for word in ("abba", "abc", "cab", "abbb", "ca", "語語語", "abbab", "zzz", "cabbage"):
        padded = "^^^^" + word + "$"
        assert scorer.value(word)[0] == pytest.approx(sum(plain(padded[k : k + 5]) for k in range(len(word) + 1)), abs=1e-5), word
    assert scorer.value("abbb")[0] != pytest.approx(sum(plain("^^^^abbb$"[k : k + 5]) for k in range(3)))


def test_empty_tables(spark):
    none = frame(spark, [(1, "x", "s")]).where("false")
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert near_dup.near_duplicates(none).count() == 0
    assert mixing.draws(none).count() == 0 and mixing.mix(none).count() == 0
    assert packing.pack(none).count() == 0
    assert training_order.materialise(none)[0].count() == 0
    assert toxicity.score(none, toxicity.train(none, labels)).count() == 0
