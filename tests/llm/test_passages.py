"""Passages inside unlike lines against brute force."""

import random

import corpus_pipeline
from fieldproof.llm import passages, substring_dedup

SCHEMA = "doc_id long, text string, source string"


def corpus():
    rng = random.Random(5)
    word = lambda: "".join(rng.choices("abcdefgh", k=6))
    words = lambda n: [word() for _ in range(n)]
    shared = words(55)
    rows = [(i, " ".join(words(rng.randint(3, 90)) + shared + words(rng.randint(3, 90))), "a") for i in range(12)]
    rows += [(20 + i, " ".join(words(200)), "b") for i in range(12)]
    rows += [(40, "\n".join(" ".join(shared[k:k + 5]) for k in range(0, 55, 5)), "c"), (41, " ".join(shared[:49]), "c")]
    rows += [(50, "x " * 80, "d"), (51, "x " * 120 + " ".join(words(30)), "d"), (60, None, "e"), (61, "", "e"), (None, rows[3][1], "f"), (3, rows[3][1], "a")]
    return rows, shared


def test_every_long_passage_is_found_and_nothing_else(spark):
    rows, shared = corpus()
    found = passages.repeated_runs(substring_dedup._texts(spark.createDataFrame(rows, SCHEMA))).collect()
    split = {i: (t or "").lower().split() for i, t, _ in rows}
    spans = {}
    for i, t, _ in rows:
        w = split[i]
        for k in range(len(w) - passages.PASSAGE_WORDS + 1):
            spans.setdefault(" ".join(w[k:k + passages.PASSAGE_WORDS]), set()).add(i)
    want = {i for ids in spans.values() if len(ids) > 1 for i in ids}
    assert {r.doc_id for r in found} >= want
    assert {*range(20, 32), 41, 60, 61}.isdisjoint({r.doc_id for r in found})
    for r in found:
        run = slice(r.first_word, r.first_word + passages.RUN_WORDS), slice(r.kept_first_word, r.kept_first_word + passages.RUN_WORDS)
        assert split[r.doc_id][run[0]] == split[r.kept_doc_id][run[1]]


def test_remove_cuts_the_passage(spark):
    rows, shared = corpus()
    docs = spark.createDataFrame(rows, SCHEMA)
    out = {r.doc_id: r.text for r in substring_dedup.remove(docs).collect()}
    assert out[0] == rows[0][1] and all(out[20 + i] == rows[12 + i][1] for i in range(12))
    assert out[40] == rows[24][1]  # short lines
    for i in (1, 2, 5, 11):
        left = out[i].split()
        assert not any(left[k:k + 25] == shared[j:j + 25] for j in range(31) for k in range(len(left) - 24))
    first = rows[1][1].split()
    assert [w for w in first if w not in shared] == [w for w in out[1].split() if w not in shared]


def test_pipeline_cuts_passages_over_short_lines(spark):
    rng = random.Random(8)
    words = lambda n: ["".join(rng.choices("abcdefgh", k=6)) for _ in range(n)]
    shared = words(120)
    wrapped = "\n".join(" ".join(shared[k:k + 12]) for k in range(0, 120, 12))
    rows = [(1, " ".join([*words(30), *shared, *words(30)]), "a"), (2, "first line\n" + wrapped + "\nlast line", "a"), (3, "\n".join(words(70)), "a")]
    out = {r.doc_id: r.text for r in corpus_pipeline.repeated_paragraphs(spark, spark.createDataFrame(rows, SCHEMA), "").collect()}
    assert out[1] == rows[0][1] and out[3] == rows[2][1]
    left = out[2].split()
    assert left[:2] == ["first", "line"] and left[-2:] == ["last", "line"]
    assert not set(left) & set(shared)


def test_spans_are_the_whole_equal_passages_against_brute_force(spark):
    rng = random.Random(9)
    words = lambda n: ["".join(rng.choices("abcdefgh", k=6)) for _ in range(n)]
    around = lambda part: words(rng.randint(1, 40)) + part + words(rng.randint(1, 40))
    rows, long = [], words(150)
    for n in range(30, 70):
        part = words(n)
        rows += [(len(rows), " ".join(around(part)), "a"), (len(rows) + 1, "\n".join(around(part)).upper(), "a")]
    rows += [(len(rows) + i, " ".join(around(long[low:high])), "b") for i, (low, high) in enumerate([(0, 90), (30, 150), (10, 130), (60, 109)])]
    both = words(60)
    rows += [(200, " ".join([*both, *words(9), *both]), "c"), (201, "x " * 80, "d"), (202, "x " * 130, "d"), (203, "x " * 130, "d"), (203, "x " * 130, "d")]
    rows += [(None, " ".join(both), "e"), (204, None, "e"), (205, "", "e")]
    size = passages.PASSAGE_WORDS
    split = {i: (t or "").lower().split() for i, t, _ in rows}
    places = {}
    for i in sorted(split, key=lambda i: (i is None, i)):
        for k in range(len(split[i]) - size + 1):
            places.setdefault(" ".join(split[i][k:k + size]), []).append((i, k))
    want = {"kept": set(), "gone": set()}
    for found in (f for f in places.values() if len(f) > 1):
        keep = found[0]
        want["kept"] |= {(keep[0], keep[1] + j) for j in range(size)}
        want["gone"] |= {(i, k + j) for i, k in found[1:] if i != keep[0] or k >= keep[1] + size for j in range(size)}
    got = {"kept": set(), "gone": set()}
    for r in passages.repeated_spans(substring_dedup._texts(spark.createDataFrame(rows, SCHEMA))).collect():
        assert r.n_words >= size
        got["kept" if r.kept else "gone"] |= {(r.doc_id, r.first_word + j) for j in range(r.n_words)}
        if split[r.doc_id][r.first_word] != "x":
            assert split[r.doc_id][r.first_word:r.first_word + r.n_words] == split[r.kept_doc_id][r.kept_first_word:r.kept_first_word + r.n_words]
    assert got == want


def test_cut():
    words = [f"w{i}" for i in range(60)]
    text = " ".join(words[:10]) + "\n" + " ".join(words[10:30]) + "\n\n" + " ".join(words[30:])
    assert passages.cut(text, [], []) == text
    assert passages.cut(text, [1], []) == " ".join(words[:10]) + "\n\n" + " ".join(words[30:])
    assert passages.cut(text, [], [5]).split() == words[:5] + words[30:]
    assert passages.cut(text, [], [5, 10]).split() == words[:5] + words[35:]
    assert passages.cut(text, [0], [10]).split() == words[35:]
    assert passages.cut(text, [], [5], 11).split() == words[:10] + words[30:]
    assert passages.cut(text, [1], [8]).split() == words[:8] + words[33:]


def test_a_kept_passage_stays_though_its_line_is_like_another(spark):
    rng = random.Random(12)
    words = lambda n: ["".join(rng.choices("abcdefgh", k=6)) for _ in range(n)]
    line = words(200)
    like = [*line[:100], "other", *line[101:]]
    third = [*words(20), *line[70:135], *words(20)]
    exact = [*words(30), *line[20:95], *words(30)]
    rows = [(1, " ".join(like), "a"), (2, " ".join(line), "a"), (3, " ".join(third), "a"), (4, "\n".join([" ".join(like), " ".join(words(5))]), "a"), (5, " ".join(exact), "a")]
    out = {r.doc_id: r.text.split() for r in substring_dedup.remove(spark.createDataFrame(rows, SCHEMA), 0).collect()}
    assert out[1] == like and out[2] == [] and out[3] == third and len(out[4]) == 5
    assert out[5] == [*exact[:30], *exact[-30:]]  # words 20 to 95 stand in document 1
    left = {w for text in out.values() for w in text}
    assert {w for _, t, _ in rows for w in t.split()} == left
    found = substring_dedup.all_repeats(spark.createDataFrame(rows, SCHEMA)).collect()
    gone = {(r.doc_id, r.line) for r in found if r.line is not None and not r.kept}
    assert not [r for r in found if r.first_word is not None and r.kept and (r.doc_id, 0) in gone]


def test_blocks_hold_every_sliding_paragraph_once():
    rng = random.Random(3)
    words = [rng.choice([b"a", b"b", b"cc"]) for _ in range(400)] + [b"x"] * 90 + [b"y%d" % i for i in range(100)]
    first, _ = passages.chosen_runs(words)
    found = list(passages.blocks(words, first.tolist()))
    covered = [b[0] + j for b in found for j in range(b[1])]
    assert covered == list(range(len(words) - passages.PASSAGE_WORDS + 1))
    assert [b[1] for b in found if b[2]] == [40]
    closed = [b[0] + j for b in passages.blocks(words, first.tolist(), [(100, 130)]) for j in range(b[1])]
    assert closed == [p for p in covered if p + passages.PASSAGE_WORDS <= 100 or p >= 130]
    assert not list(passages.blocks(words[:49], []))


def test_signature_of_a_long_line_in_parts():
    import numpy as np

    shingles = np.random.default_rng(1).integers(0, 1 << 63, 1000, np.uint64)
    starts = np.array([0, 3, 500, 501, 990])
    whole = substring_dedup._signatures(shingles, starts)
    assert (substring_dedup._signatures(shingles, starts, 64) == whole).all()
    assert (whole[2] == shingles[500] * substring_dedup._FACTORS[0] + substring_dedup._FACTORS[1]).all()


def test_words_that_come_round_are_one_span(spark):
    """A few words again and again had a span for every round."""
    rng = random.Random(14)
    words = lambda n: ["".join(rng.choices("abcdefgh", k=6)) for _ in range(n)]
    texts = [["a", "b"] * 100, [*words(7), *["a", "b"] * 150, *words(9)], [*["b", "a"] * 40, *words(60)], ["p", "q", "r"] * 60, [*words(3), *["q", "r", "p"] * 50]]
    size, places = passages.PASSAGE_WORDS, {}
    for i, w in enumerate(texts):
        for k in range(len(w) - size + 1):
            places.setdefault(tuple(w[k:k + size]), []).append((i, k))
    gone = {(i, k + j) for f in places.values() for i, k in f[1:] if i != f[0][0] or k >= f[0][1] + size for j in range(size)}
    rows = [(i, "\n".join(w), "a") for i, w in enumerate(texts)]
    found = [r for r in passages.repeated_spans(substring_dedup._texts(spark.createDataFrame(rows, SCHEMA))).collect()]
    assert {(r.doc_id, r.first_word + j) for r in found if not r.kept for j in range(r.n_words)} == gone
    assert len(found) == 7  # the two kept places, the rest of their rounds, and one in each of the others
