"""Repeated passages, phrases and vector codes against plain versions, and on odd rows."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import compare
import numpy as np
import pytest

from crawlspark.llm import phrases, queries, sql_texts, suffix_index, vector_codes

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, tie long, data string, bucket long, n long, phrase string"


def docs(spark, rows):
    """Documents from (doc_id, text, lang), with columns named like the operators' own."""
    return spark.createDataFrame([(i, t, g, 7, "d", -1, 3, "p") for i, t, g in rows], DOCS).repartition(3)


@pytest.fixture(scope="module")
def con():
    return compare.connect(SF)


@pytest.mark.parametrize("name", ["op4_hyperminhash", "op7_pca_tiles", "op9_blocked_bloom", "op11_suffix_family", "op12_fingerprints", "op13_ball_kmeans"])
def test_rows_equal_sql(spark, con, name):
    assert compare.compare(spark, con, queries.QUERIES[name], queries.ORACLES[name], SF) is None


def plain_removed(rows, length):
    """Byte by byte, documents by doc_id (null last), equal ids in the given order."""
    seen, out = set(), []
    for i, t in rows:
        data = (t or "").encode()
        gone = bytearray(len(data))
        for p in range(len(data) - length + 1):
            if data[p : p + length] in seen:
                gone[p : p + length] = b"\1" * length
            seen.add(data[p : p + length])
        kept = bytes(c for c, g in zip(data, gone, strict=True) if not g)
        spans = [(m.start(), m.end() - m.start()) for m in re.finditer(b"\1+", bytes(gone))]
        out.append((i, len(data), sum(gone), len(spans), hashlib.sha256(kept).hexdigest(), spans, kept))
    return out


def removed(spark, rows, length=100, texts=True):
    got = suffix_index.remove_repeats(docs(spark, [(i, t, None) for i, t in rows]), length, texts).collect()
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256, [tuple(s) for s in r.spans], r.kept and bytes(r.kept)) for r in got), key=str)


def passages(seed, length):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé ") for _ in range(rng.randint(1, 9)))
    text = lambda n: "".join(word() for _ in range(n))
    shared = [text(rng.randint(5, 60)) for _ in range(6)]
    rows = [(i, text(rng.randint(0, 40)) + "".join(rng.choice([rng.choice(shared), text(12)]) for _ in range(rng.randint(0, 6)))) for i in range(60)]
    edge = "".join(rng.choice("xyz") for _ in range(length))
    rows += [(70, edge), (71, "q" + edge), (72, edge + "r"), (73, edge[1:]), (74, edge[:-1] + "s" + edge)]
    rows += [(80, "a" * 3 * length), (81, "ab" * 2 * length), (82, "b" + "a" * 2 * length), (90, None), (91, ""), (92, "short")]
    return rows


@pytest.mark.parametrize("length", [100, 24, 2])
def test_removed_bytes_equal_brute_force(spark, length):
    rows = passages(length, length)
    assert removed(spark, rows, length) == sorted(plain_removed(rows, length), key=str)


def test_removal_over_many_chunks_and_slices(spark, monkeypatch):
    monkeypatch.setattr(suffix_index, "BUCKET", 64)  # many buckets; chunk and slice sizes are read by the workers' own modules
    rows = passages(5, 100) + [(199, "-" * 700_000), (200, "".join(random.Random(9).choices("uvw ", k=1_300_000)))]
    rows += [(201, rows[-1][1][400_000:900_000])]
    assert removed(spark, rows, texts=False) == sorted(((*r[:6], None) for r in plain_removed(rows, 100)), key=str)


def test_family_levels_halve_and_find_what_one_sort_finds():
    rng = np.random.default_rng(2)
    family, every = suffix_index.Family(), []
    for k in range(21):
        n = int(rng.integers(0, 30))
        gram, whole = (rng.integers(m, size=n).astype(np.uint64) for m in (40, 3))
        place = np.arange(n).astype(np.uint32)
        kept = np.unique(np.stack([gram, whole], 1), axis=0, return_index=True)[1]
        batch = [gram[kept], whole[kept], rng.integers(9, size=len(kept)), np.zeros(len(kept), np.int64), place[kept], np.zeros(len(kept), np.uint16)]
        family.add(k, *batch)
        every += [(*map(int, (g, w, d)), k, int(p)) for g, w, d, p in zip(*batch[:3], batch[4], strict=True)]
        sizes = [len(level["gram"]) for level in family.levels]
        assert all(a >= 2 * b for a, b in zip(sizes, sizes[1:], strict=False))
    first = {}
    for g, w, *at in sorted(every):
        first.setdefault((g, w), tuple(at))
    grams = Counter(g for g, _ in first)
    levels = [tuple(int(x) for x in r) for level in family.levels for r in zip(*(level[f] for f in ("gram", "whole", "doc", "chunk", "place", "edge")), strict=True)]
    assert sorted(levels) == sorted((*k, *at, int(grams[k[0]] > 1)) for k, at in first.items())
    gone = [(int(c), int(p)) for chunk, place, _ in family.repeats for c, p in zip(chunk, place, strict=True)]
    assert sorted(gone) == sorted({(k, p) for _, _, _, k, p in every} - {at[1:] for at in first.values()})


def test_rows_that_share_an_id_and_nothing_at_all(spark):
    text = "".join(random.Random(1).choices("abcdef", k=300))
    rows = [(5, text), (5, text), (5, text), (None, text), (None, text + "x"), (5, None)]
    got = removed(spark, rows)
    assert [r[2] for r in got if r[0] == 5 and r[1]] in ([0, 300, 300], [300, 0, 300], [300, 300, 0])
    assert sorted((r[1], r[2]) for r in got if r[0] is None) == [(300, 300), (301, 300)] or sorted((r[1], r[2]) for r in got if r[0] is None) == [(300, 300), (301, 301)]
    assert removed(spark, []) == []
    other = removed(spark, [(5, text), (5, text[:150] + "-" + text[150:])])
    assert sum(r[2] for r in other) in (300, 301)


def plain_collocations(rows, most, least, top):
    counts, total = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lowered):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(w)
            counts[lang].update(tuple(w[i : i + n]) for n in range(1, most + 1) for i in range(len(w) - n + 1))
    out = []
    for lang, f in counts.items():
        candidates = [p for p, a in f.items() if len(p) > 1 and a >= least]
        inside = {q[i : i + n] for q in candidates for n in range(2, len(q)) for i in range(len(q) - n + 1) if f[q[i : i + n]] == f[q]}
        found = []
        for p in set(candidates) - inside:
            score, k = min((1000 * f[p] * total[lang] // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            found.append((-score, -f[p], " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, l, r, total[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(found)[:top])]
    return Counter(out)


@pytest.mark.parametrize(("most", "least", "top"), [(5, 3, 10_000), (3, 2, 5), (2, 300, 10)])
def test_collocations_equal_brute_force(spark, most, least, top):
    rng = random.Random(4)
    words = ["alpha", "Beta", "gamma", "ΔELTA", "été", "x", "y\0z", " ", "of", "the", " "]
    rows = [("".join(rng.choice(words) + rng.choice([" ", " ", "  ", "\t", ". ", "\n", "\x0b", ","]) for _ in range(rng.randint(0, 60))), rng.choice(["en", "de", None, "und"])) for _ in range(80)]
    rows += [(None, "en"), ("", None), (" \t\n.", "fr"), ("of the " * 20_000, "en")] + [("same same words here", "fr")] * 5
    got = phrases.collocations(docs(spark, [(1, t, g) for t, g in rows]), most, least, top).collect()
    assert Counter(tuple(r) for r in got) == plain_collocations(rows, most, least, top)
    assert phrases.collocations(docs(spark, [])).collect() == []


def test_equal_fingerprints_do_not_mix_counts(spark, con, monkeypatch):
    """Few cells: nearly all n-grams share theirs, and results stay the same."""
    monkeypatch.setattr(phrases, "RANGE_GRAMS", 1 << 10)
    fn = lambda s, d: phrases.collocations(s.read.parquet(f"{d}/documents.parquet"), least=4)
    assert compare.compare(spark, con, fn, sql_texts.phrases(4), SF) is None


def test_grams_with_one_fingerprint_are_told_apart():
    block = object.__new__(phrases._Block)
    block.langs, block.words, block.lang = ["en"], [b"a", b"b"], np.zeros(4, np.uint32)
    block.tokens = np.array([0, 1, 0, 0], np.uint32)
    grouped = {c.co_name: c for c in phrases._texts_of.__code__.co_consts if hasattr(c, "co_name")}
    assert "grouped" in grouped  # the function below is the one tasks run
    run = type(test_grams_with_one_fingerprint_are_told_apart)(grouped["grouped"], vars(phrases))
    got = sorted((block.words[block.tokens[i]], c) for i, c, _ in run(block, 1, np.arange(4), np.full(4, 9, np.uint64)))
    assert got == [(b"a", 3), (b"b", 1)]


VECTORS = "vec_id long, embedding array<float>, label int, kind int, part int, entry int, error long"


def vectors(spark, rows):
    floats = lambda v: v and [x if x is None else float(x) for x in v]
    return spark.createDataFrame([(i, floats(v), g, -1, -1, -1, -1) for i, v, g in rows], VECTORS).repartition(3)


def plain_codes(rows, parts=4, entries=256, rounds=4):
    """Whole numbers of Python, every part against every entry."""
    kept = [(i, v, g) for i, v, g in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = -(-max((len(v) for _, v, _ in kept), default=0) // parts)
    whole = [[math.floor(1024 * float(np.float32(x))) for x in v] + [0] * (parts * width - len(v)) for _, v, _ in kept]
    order = sorted(range(len(kept)), key=lambda k: (kept[k][0] is None, kept[k][0] or 0, [float(np.float32(x)) for x in kept[k][1]]))
    cut = [[w[p * width : (p + 1) * width] for p in range(parts)] for w in whole]
    books = [[cut[k][p] for k in order[:entries]] for p in range(parts)]
    nearest = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), e) for e, c in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            groups = defaultdict(list)
            for x in cut:
                groups[nearest(x[p], books[p])[1]].append(x[p])
            for e, xs in groups.items():
                books[p][e] = [sum(c) // len(xs) for c in zip(*xs, strict=True)]
    found = [[nearest(x[p], books[p]) for p in range(parts)] for x in cut]
    errors = [sum(d for d, _ in f) for f in found]
    per = Counter()
    for (_, _, g), e in zip(kept, errors, strict=True):
        per[g] += e
    text = ",".join(str(y) for book in books for c in book for y in c)
    rows = [(i, "".join(f"{e:02x}" for _, e in f), err, per[g]) for (i, _, g), f, err in zip(kept, found, errors, strict=True)]
    return sorted(rows, key=str), hashlib.sha256(text.encode()).hexdigest()


def codes(spark, rows, **how):
    out, books = vector_codes.compress(vectors(spark, rows), **how)
    return sorted(((r.vec_id, r.code, r.error, r.label_error) for r in out.collect()), key=str), vector_codes.digest(books)


def test_codes_equal_brute_force(spark):
    rng = random.Random(6)
    centres = [[rng.uniform(-1, 1) for _ in range(8)] for _ in range(5)]
    rows = [(k, [x + rng.uniform(-0.2, 0.2) for x in rng.choice(centres)], rng.choice([1, 2, None])) for k in range(500)]
    rows += [(600 + k, [rng.choice([0.0, 0.25, -0.25]) for _ in range(8)], 3) for k in range(120)]  # ties
    assert codes(spark, rows) == plain_codes(rows)
    assert codes(spark, rows, entries=7, rounds=2) == plain_codes(rows, entries=7, rounds=2)


def test_codes_of_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [0.5] * 4, 1), (2, None, 1), (3, [nan] * 4, 1), (4, [inf, 0, 0, 0], 2), (5, [None, 0, 0, 0], 2), (6, [0.0] * 4, None), (6, [0.0] * 4, None), (7, [], None)]
    rows += [(8, [1.0, 2.0, 3.0], 2), (9, [-0.001, 0.001, -1.5, 2.5, 3.5], 2), (None, [0.1] * 6, 2), (6, [-2.0] * 4, 1), (10, [3e8, -3e8, 1.0, 2.0], 5)]
    assert codes(spark, rows) == plain_codes(rows)
    huge = codes(spark, [*rows, (11, [3e38, -3e38, 0.0, 0.0], 6), (12, [-3e38, 3e38, 0.0, 0.0], 6)], entries=2)[0]
    assert len(huge) == len(codes(spark, rows)[0]) + 2 and max(r[2] for r in huge) <= (1 << 63) - 1
    assert codes(spark, [(1, None, 1)])[0] == []


def test_ball_search_equals_full_search():
    rng = np.random.default_rng(8)
    x, c = rng.integers(-6, 7, (3000, 3)), rng.integers(-6, 7, (40, 3))
    full = vector_codes.nearest_entries(x, c, None)
    for own in (rng.integers(40, size=3000), full[0], np.zeros(3000, np.int64)):
        at, best = vector_codes.nearest_entries(x, c, own)
        assert (at == full[0]).all() and (best == full[1]).all()
