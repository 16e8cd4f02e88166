"""SimHash, paragraph and mixing operators against brute force."""

import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from fieldproof.llm import mixing, simhash, substring_dedup
from fieldproof.llm.links import components

SCHEMA = "doc_id long, text string, source string"


def frame(spark, rows, schema=SCHEMA):
    return spark.createDataFrame(rows, schema)


def roots(nodes, linked):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    nodes = sorted(nodes)
    for i, a in enumerate(nodes):
        for b in nodes[i + 1:]:
            if linked(a, b):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


def plain_fingerprint(text):
    words = text.encode().lower().split()
    if not words:
        return 0
    grams = [words[i:i + 3] for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(b" ".join(g), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def corpus():
    random.seed(3)
    words = [f"w{i}" for i in range(400)]
    rows = []
    for i in range(60):
        text = " ".join(random.choices(words, k=random.randint(1, 120)))
        rows.append((i, text, f"s{i % 3}"))
        if i % 4 == 0:
            rows.append((100 + i, text.upper() if i % 8 else text + " tail", "s0"))
    return [*rows, (500, None, None), (501, "", "s1"), (502, " \n\t", "s1"), (3, rows[3][1], "s0"), (None, "alone here", "s2"), (503, "a" * 200_000, "s2"), (504, "x y " * 60_000, "s2")]


def test_fingerprints_and_components(spark):
    rows = corpus()
    got = {(r.doc_id, r.fp & (1 << 64) - 1): r.component_id for r in simhash.near_duplicates(frame(spark, rows)).collect()}
    want = [(i, plain_fingerprint(t or "")) for i, t, _ in rows]
    assert set(got) == set(want)
    first = {}
    for i, fp in want:
        if i is not None:
            first[fp] = min(first.get(fp, i), i)
    root = roots({fp for _, fp in want}, lambda a, b: (a ^ b).bit_count() <= 3)
    best = {}
    for fp in root:
        best[root[fp]] = min(best.get(root[fp], 10 ** 9), first.get(fp, 10 ** 9))
    assert got == {(i, fp): (b if (b := best[root[fp]]) < 10 ** 9 else None) for i, fp in want}


def test_hot_bucket_in_cells(spark, monkeypatch):
    random.seed(5)
    base, near = random.getrandbits(64), set()
    while len(near) < 300:
        near.add(base ^ sum(1 << b for b in random.sample(range(64), random.randint(0, 5))))
    far = {random.getrandbits(64) for _ in range(200)}
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    fps = frame(spark, [(signed(x),) for x in near | far], "fp long")
    from fieldproof.llm.links import cells
    links = cells(simhash.keyed(fps), "fp", 16).mapInPandas(simhash.links_in_cells, "a long, b long")
    got = {r.node: r.component for r in components(links).collect()}
    want = roots({signed(x) for x in near | far}, lambda a, b: ((a ^ b) & (1 << 64) - 1).bit_count() <= 3)
    classes = {}
    for n, r in want.items():
        classes.setdefault(r, set()).add(n)
    found = {}
    for n, c in got.items():
        found.setdefault(c, set()).add(n)
    assert sorted(map(sorted, found.values())) == sorted(sorted(c) for c in classes.values() if len(c) > 1)


def test_components_of_a_chain_and_a_hub(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 300)] + [(7, 7)]
    got = {r.node: r.component for r in components(frame(spark, edges, "a long, b long")).collect()}
    assert len({got[i] for i in range(201)}) == 1 and len({got[1000 + i] for i in range(300)}) == 1 and len(set(got.values())) == 2


def test_one_of_each_group_stays(spark):
    rows = corpus()
    kept = simhash.keep_one(frame(spark, [(*r, 1, 2) for r in rows], SCHEMA + ", fp int, h int"))
    assert kept.columns == ["doc_id", "text", "source", "fp", "h"]
    ids = [r.doc_id for r in kept.collect()]
    groups = {(r.component_id if r.component_id is not None else "none") for r in simhash.near_duplicates(frame(spark, rows)).collect()}
    assert len(ids) == len(groups) and sorted(ids, key=str) == sorted((None if g == "none" else g for g in groups), key=str)


def shingles(line):
    w = line.lower().split()
    return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))}


def paragraphs():
    random.seed(11)
    words = [f"v{i}" for i in range(900)]
    line = lambda n: " ".join(random.choices(words, k=n))
    shared, boiler = [line(60) for _ in range(6)], "short repeated line"
    rows = []
    for i in range(40):
        lines = [line(random.randint(5, 80)) for _ in range(4)] + [boiler]
        if i % 3 == 0:
            near = shared[i % 6].split()
            near[random.randrange(60)] = "changed"
            lines.insert(2, " ".join(near))
        if i % 5 == 0:
            lines.append(shared[i % 6].upper())
        rows.append((i, "\n".join(lines), "s"))
    return [*rows, (90, None, None), (91, "", "s"), (92, rows[3][1], "s"), (5, rows[5][1], "s"), (93, "long " * 100_000, "s")]


def test_paragraphs_against_brute_force(spark):
    rows = paragraphs()
    found = substring_dedup.repeats(frame(spark, rows)).collect()
    places = [(i, n, x) for i, t, _ in rows for n, x in enumerate((t or "").split("\n")) if len(x.split()) >= substring_dedup.MIN_WORDS]
    text = {" ".join(x.lower().split()) for _, _, x in places}
    jaccard = lambda a, b: len(a & b) / len(a | b)
    sets = {x: shingles(x) for x in text}
    root = roots(text, lambda a, b: jaccard(sets[a], sets[b]) >= 0.8)
    groups = {}
    for i, n, x in places:
        groups.setdefault(root[" ".join(x.lower().split())], []).append((i, n))
    want = sorted(p for g in groups.values() if len(g) > 1 for p in g)
    assert sorted((r.doc_id, r.line) for r in found) == want
    keep = {p: min(g) for g in groups.values() for p in g}
    assert all((r.kept_doc_id, r.kept_line) == keep[r.doc_id, r.line] for r in found)
    assert all(r.kept == ((r.doc_id, r.line) == keep[r.doc_id, r.line]) for r in found)


def test_removal_changes_texts_only(spark):
    rows = paragraphs()
    docs = frame(spark, [(*r, len(r[1] or ""), "x") for r in rows], SCHEMA + ", n_chars int, gone string")
    left = substring_dedup.remove(docs)
    assert left.columns == docs.columns and left.count() == docs.count()
    out = {r.doc_id: r for r in left.collect()}
    assert out[92].text == "\n".join(x for x in rows[3][1].split("\n") if len(x.split()) < 20)
    assert all(r.text is None or r.n_chars == len(r.text) for r in out.values()) and out[90].text is None
    assert all("short repeated line" in out[i].text for i in range(40))


def test_bands_reach_the_recall():
    bands, rows = substring_dedup.tune_bands()
    assert 1 - (1 - 0.8 ** rows) ** bands >= substring_dedup.RECALL
    rng, hits = np.random.default_rng(0), 0
    for _ in range(300):
        both = rng.integers(0, 1 << 63, 80, np.uint64)
        a, b = np.r_[both, rng.integers(0, 1 << 63, 9, np.uint64)], np.r_[both, rng.integers(0, 1 << 63, 9, np.uint64)]
        ka, kb = substring_dedup.band_keys(np.r_[a, b], np.array([0, len(a)]))
        hits += bool((ka == kb).any())
    assert hits >= 298


def test_mix_near_targets(spark):
    rows = [(i, "w " * (1 + i * 37 % 200), ["a", "b", "c", None][i % 4] if i % 10 else "a") for i in range(800)]
    rows += [(900, None, "empty"), (901, "x", "b"), (901, "x", "b"), (None, "y z", "c")]
    plan = mixing.plan(frame(spark, rows)).collect()
    assert len(plan) == len(rows)
    total, by = sum(r.size for r in plan), {}
    for r in plan:
        assert r.size == len((next((t for i, t, s in rows if i == r.doc_id and s == r.source), "") or "").split())
        assert 0 <= r.taken <= 3 * r.size
        have = by.setdefault(r.source, [r.source_size, r.target, 0, 0])
        have[2] += r.taken
        have[3] += r.size
    assert abs(sum(v[1] for v in by.values()) - total) < 1e-6
    for size, target, taken, found in by.values():
        assert size == found and target <= 3 * size + 1e-9 and abs(taken - target) <= 0.03 * target + 200
    order = sorted((s for s in by if s is not None)) + [None]
    weight = {s: mixing.WEIGHTS[i % 3] for i, s in enumerate(order)}
    free = [s for s in order if by[s][1] < 3 * by[s][0]]
    assert len({round(by[s][1] / weight[s], 6) for s in free}) == 1
    assert sorted(plan, key=str) == sorted(mixing.plan(frame(spark, rows)).collect(), key=str)
    mixed = mixing.sample(frame(spark, [(*r, 1) for r in rows], SCHEMA + ", copies int"))
    assert mixed.columns == ["doc_id", "text", "source", "copies"] and mixed.count() == sum(r.copies for r in plan)


@pytest.mark.parametrize("run", [simhash.near_duplicates, simhash.keep_one, substring_dedup.repeats, substring_dedup.remove, mixing.plan, mixing.sample])
def test_empty_table(spark, run):
    assert run(frame(spark, [])).filter(F.lit(True)).count() == 0
