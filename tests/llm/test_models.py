"""BPE, language, context mixing and the pipeline."""

import random
import zlib
from collections import Counter

import corpus_pipeline
import numpy as np
import pyarrow as pa
import regex
from compare import DATA
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from fieldproof.llm import bpe, context_mixing, language, lexicon
from fieldproof.llm.common import lower_words, table

DOCS = "doc_id long, text string, lang string, source string"
SF = f"{DATA}/sf0.001"


def test_bpe_equals_the_library(spark):
    library = Tokenizer.from_file(bpe.default_vocabulary())
    random.seed(6)
    texts = ["".join(random.choices("abc thé 12.\n\t!'s日🙂<|endoftext|>\x1c\x85", k=random.randint(0, 60))) for _ in range(300)]
    texts += [None, "", "<|endoftext|>" * 3, "a<|endoftext|> b", "x" * 5000, "don't they'll" * 500, " \n " * 50] + [r.text for r in table(spark, SF, "documents").select("text").collect()]
    docs = spark.createDataFrame([(i, t, "q") for i, t in enumerate(texts)], "doc_id long, text string, ids string")
    for words in (0, 50, bpe.LEXICON_WORDS):
        rows = bpe.decode(bpe.encode(docs, most=words)).collect()
        assert len(rows) == len(texts)
        for r in rows:
            want = library.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
            assert np.frombuffer(r.ids, "<u4").tolist() == want
            assert r.decoded == library.decode(want, skip_special_tokens=False)
    assert bpe.round_trip(docs.limit(0)).count() == 0


def test_broken_ids_decode_like_the_library(spark):
    library = Tokenizer.from_file(bpe.default_vocabulary())
    random.seed(8)
    rows = [(i, np.array(random.choices(range(50_257), k=8), "<u4").tobytes()) for i in range(300)]
    for r in bpe.decode(spark.createDataFrame(rows, "doc_id long, ids binary")).collect():
        assert r.decoded == library.decode(np.frombuffer(r.ids, "<u4").tolist(), skip_special_tokens=False)


def test_latin_texts_split_without_classes_of_unicode():
    split = bpe.Splitter([])
    full = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+").findall
    random.seed(9)
    signs = [" ", " ", "'", *"stredvlm1_\n\t\xa0\x85\x1c²½ªºßé’—", *map(chr, range(0xA0, 0x300)), *map(chr, range(0x2000, 0x2100))]
    for text in ["é" + "".join(random.choices(signs, k=12)) for _ in range(5000)]:
        assert split(text) == full(text)
    split.words = None  # not needed for these
    assert split("Größe: l'été, 12 “dés” – 3 €") == ["Größe", ":", " l", "'", "été", ",", " 12", " “", "dés", "”", " –", " 3", " €"]


def test_lexicon(tmp_path):
    random.seed(1)
    words = sorted({"".join(random.choices("abc", k=random.randint(1, 7))).encode() for _ in range(500)} | {b"nation", b"ration", b"station"})
    arrays = lexicon.build([(w, [i, i + 1]) for i, w in enumerate(words)])
    lexicon.save(arrays, str(tmp_path / "w.bin"))
    found = lexicon.Lexicon(str(tmp_path / "w.bin"))
    assert found.places(words).tolist() == list(range(len(words)))
    assert found.places([b"", b"zzz", words[0] + b"\xff", b"natio"]).tolist() == [-1] * 4
    assert found.outputs(17).tolist() == [17, 18]
    suffixes = {frozenset(w[len(p):] for w in words if w.startswith(p)) for word in words for p in (word[:k] for k in range(len(word) + 1))}
    assert len(arrays["final"]) == len(suffixes)  # as few states as there are sets of endings
    lexicon.save(lexicon.build([]), str(tmp_path / "none.bin"))
    assert lexicon.Lexicon(str(tmp_path / "none.bin")).places([b"a"]).tolist() == [-1]


def test_language_accuracy_and_rejection(spark):
    docs = table(spark, f"{DATA}/sf0.01", "documents")
    odd = spark.createDataFrame([(90_000, None, None, None), (90_001, "", "en", "s"), (90_002, "123 456 $$$", None, "s"), (None, "the of and ing", "en", None)], DOCS)
    both = docs.select("doc_id", "text", "lang", "source").unionByName(odd).withColumn("host", F.lit(1))
    found = language.identify(both, table(spark, f"{DATA}/sf0.01", "pages"))
    joined = found.join(docs.select("doc_id", F.col("lang").alias("truth")), "doc_id").collect()
    assert len(joined) == 1000 and np.mean([r.lang == r.truth for r in joined]) >= 0.99 and all(r.kept for r in joined)
    rejected = {r.doc_id: (r.kept, r.lang) for r in found.filter("doc_id >= 90000").collect()}
    assert rejected == {90_000: (False, None), 90_001: (False, None), 90_002: (False, None)}
    kept = language.keep(both)
    assert kept.columns == both.columns and kept.count() == 1001


def test_rare_language_beside_many_copies(spark, monkeypatch):
    monkeypatch.setattr(language, "SAMPLE_ROWS", 30)
    rng = random.Random(4)
    text = lambda letters: " ".join("".join(rng.choices(letters, k=5)) for _ in range(40))
    common, rare = [text("abcdefgh") for _ in range(40)], [text("stuvwxyz") for _ in range(4)]
    rows = [(t, "en") for t in common for _ in range(100)] + [(t, "xx") for t in rare]
    labelled = spark.createDataFrame(rows, "text string, lang string").coalesce(2)
    names, table_ = language.fit(labelled)
    assert names == ["en", "xx"]
    score = lambda t: names[int(table_[:, language.trigrams(t)].sum(axis=1).argmax())]
    assert score(text("abcdefgh")) == "en" and score(text("stuvwxyz")) == "xx"


def test_language_of_long_texts_alone(spark):
    rng = random.Random(4)
    said = lambda letters, n: " ".join("".join(rng.choices(letters, k=5)) for _ in range(n))
    rows = [(i, said("abcdef", 40), "en", "s") for i in range(30)] + [(100 + i, said("uvwxyz", 5000), "xx", "s") for i in range(10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    names, fitted = language.fit(docs.select("text", "lang"))
    assert names == ["en", "xx"]
    for at, name in enumerate(names):
        n = sum(np.bincount(language.trigrams(t), minlength=language.BUCKETS) for _, t, lang, _ in rows if lang == name)
        assert np.allclose(fitted[at], np.log((n + 0.1) / (n.sum() + 0.1 * language.BUCKETS)), atol=1e-4)
    assert all(r.lang == ("en" if r.doc_id < 100 else "xx") for r in language.identify(docs).collect())


def test_language_without_rows_or_labels(spark):
    empty = spark.createDataFrame([], DOCS)
    assert language.identify(empty).count() == 0 and language.keep(empty).count() == 0
    unlabelled = spark.createDataFrame([(1, "words here", None, "s"), (2, "...", None, "s")], DOCS)
    assert {r.doc_id: r.kept for r in language.identify(unlabelled).collect()} == {1: True, 2: False}


def test_context_mixing_base_and_gain(spark):
    docs = table(spark, f"{DATA}/sf0.01", "documents").select("doc_id", "text")
    odd = spark.createDataFrame([(70_000, None), (70_001, ""), (None, "the of"), (7, "Repeated row ZZZ"), (7, "Repeated row ZZZ"), (70_002, "q" * 100_000)], "doc_id long, text string")
    rows = docs.unionByName(odd).withColumn("base", F.lit(0))
    found = context_mixing.scores(rows).collect()
    texts = [(r.doc_id, r.text or "") for r in rows.select("doc_id", "text").collect()]
    out = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 10 == 0
    counts = Counter()
    for i, t in texts:
        if not out(i):
            counts.update([*lower_words(t), context_mixing.END])
    n, v = sum(counts.values()), len(counts)
    want = []
    for i, t in texts:
        tokens = [*lower_words(t), context_mixing.END]
        base = sum(np.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in tokens)
        want.append((str(i), out(i), len(tokens), sum(counts[w] > 0 for w in tokens), n, round(base, 5)))
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5)) for r in found) == sorted(want)
    held = [r for r in found if r.held_out and r.doc_id is not None and r.doc_id < 1000]
    assert 0 < np.mean([r.bits_per_byte for r in held]) < 3.0  # eight without a model
    assert context_mixing.scores(docs.limit(0)).count() == 0


def test_word_probabilities_add_up(spark, tmp_path):
    """Over all words of one byte and the longer ones' first bytes, probabilities sum to at most one."""
    rows = context_mixing._texts(table(spark, SF, "documents"))
    model, _ = context_mixing.fit(rows)
    scorer = context_mixing.Scorer(model)
    single = [bytes([b]) for b in range(256) if b not in (*range(9, 14), 32, context_mixing.END_BYTE)]
    for state in (0, 1):
        total = np.exp(-scorer.word_costs([*single, context_mixing.END], state)).sum()
        assert 0 < total <= 1 + 1e-6


def test_pipeline_stages(spark):
    docs = table(spark, SF, "documents").withColumn("row", F.lit(1)).withColumn("copies", F.lit("x"))
    columns, before = docs.columns, docs
    sizes = {}
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, before, SF)
        if name != "bpe":
            assert after.columns == columns
        sizes[name] = after.count()
        before = after
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "simhash", "substring_dedup", "mixing", "bpe"]
    assert sizes["language_id"] == 200 and sizes["simhash"] < 200 and sizes["substring_dedup"] == sizes["simhash"] and sizes["bpe"] == sizes["mixing"]
    library = Tokenizer.from_file(bpe.default_vocabulary())
    texts = {}
    mixed = corpus_pipeline.STAGES[2][1](spark, corpus_pipeline.STAGES[1][1](spark, corpus_pipeline.STAGES[0][1](spark, docs, SF), SF), SF)
    for r in mixed.collect():
        texts[r.doc_id] = r.text
    for r in before.collect():
        assert np.frombuffer(r.ids, "<u4").tolist() == library.encode(texts[r.doc_id], add_special_tokens=False).ids
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, SF)
    assert empty.count() == 0


def test_context_mixing_learns_from_every_training_text(spark):
    """Long texts teach too, and more of them than a sample would hold; the way the rows are dealt does not matter."""
    words = [f"{a}{b}" for a in ("der ", "die ", "und ") for b in ("haus ", "weg ", "tag ")], [f"{a}{b}" for a in ("the ", "of ", "and ") for b in ("house ", "way ", "day ")]
    random.seed(4)
    texts = ["".join(random.choices(words[i % 2], k=3000)) for i in range(12)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    model, counts = context_mixing.fit(context_mixing._texts(docs))
    assert set(model.kinds) == {bytes(r.token) for r in counts.collect()}
    kind = model.by_kind.argmax(axis=1)
    assert kind[model.kinds[b"der"]] == kind[model.kinds[b"tag"]] != kind[model.kinds[b"the"]] == kind[model.kinds[b"day"]]
    assert (model.weights != context_mixing.START).any()
    again, _ = context_mixing.fit(context_mixing._texts(docs.repartition(5)))
    assert np.allclose(model.weights, again.weights, atol=2e-4) and (model.by_kind == again.by_kind).all()
    more = docs.filter("doc_id % 2 = 0")
    less, _ = context_mixing.fit(context_mixing._texts(more))
    assert not np.allclose(model.weights, less.weights, atol=2e-4)


def test_tables_are_counted_in_parts_and_equal_one_count(spark):
    """A task held counts of the whole table; parts of it add up to the same log-odds."""
    from fieldproof.llm import context_mixing as cm

    assert cm.RANGES[0][0] == 0 and cm.RANGES[-1][1] == cm.TABLE_CELLS and all(a[1] == b[0] for a, b in zip(cm.RANGES, cm.RANGES[1:]))
    assert all(high - low < 0.3 * cm.TABLE_CELLS and low % cm.CHUNK == 0 for low, high in cm.RANGES)
    rng = random.Random(4)
    rows = [("".join(rng.choices("abcdeé", k=rng.randint(1, 9))).encode(), rng.randint(0, 3), rng.randint(0, 1), rng.randint(1, 5)) for _ in range(400)]
    code = cm.codes_of(list(b"abc"))
    paths = cm.build_tables(spark.createDataFrame([(bytearray(w), s, f, c) for w, s, f, c in rows], "token binary, state int, fold int, c long"), code)
    cells = np.zeros(cm.TABLE_CELLS, np.float32)
    for w, s, _, c in rows:
        data, place = cm.symbols([w])
        for state in {s, 0}:
            for k, row in enumerate(cm.context_rows(data, place, state)):
                if cm.WITH_STATE[k] or state == s:
                    np.add.at(cells, row + code[data], c)
        where = np.flatnonzero(code[data] == cm.ESCAPE)
        np.add.at(cells, cm.FIRST_CELL[-1] + (cm._before(data, place, where) << 8) + data[where], c)
    want = np.r_[cm._log_odds(cells[:cm.FIRST_CELL[-1]], 32), cm._log_odds(cells[cm.FIRST_CELL[-1]:], 256)]
    assert (np.memmap(paths[-1].removeprefix("file:"), np.int8, "r") == want).all()


def _fitted(spark, texts):
    from fieldproof.llm import context_mixing as cm

    rows = spark.createDataFrame([(t, i % 2) for i, t in enumerate(texts)], "text string, fold int")
    none = {}, np.zeros((0, 1))
    counts = cm.token_counts(rows, *none).cache()
    code = cm.codes_of(cm.byte_order(counts.groupBy("token").agg(F.sum("c").alias("c"))))
    *halves, whole = (cm.Model(code, path, *none) for path in cm.build_tables(counts, code))
    return cm, counts, halves, whole


def test_weights_are_fitted_until_they_settle(spark):
    """two steps of at most 0.4 left weights that a third one would still have moved."""
    rng = random.Random(5)
    words = ["".join(rng.choices("abcdefgh", k=rng.randint(1, 8))) for _ in range(300)]
    cm, counts, halves, _ = _fitted(spark, [" ".join(rng.choices(words, weights=range(1, 301), k=400)) for _ in range(40)])
    start = halves[0].weights
    cm.fit_weights(counts, halves)
    assert np.abs(halves[0].weights - start).max() > cm.MOST_STEP and (halves[0].weights == halves[1].weights).all()
    assert np.abs(cm.newton_step(counts, halves) - halves[0].weights).max() < cm.SETTLED / 4


def test_weights_learn_from_every_byte_of_a_text(spark):
    """scoring left the weights as they were fitted; here a plain loop moves them after every byte."""
    rng = random.Random(6)
    words = ["".join(rng.choices("abcdefgh", k=rng.randint(1, 8))) for _ in range(200)]
    cm, _, _, model = _fitted(spark, [" ".join(rng.choices(words, k=300)) for _ in range(20)])
    texts = [" ".join(rng.choices([*words, "zé", "abba"], k=n)) for n in (0, 3, 40, 41, 200)]
    scorer = cm.Scorer(model)
    read = scorer.reader.read(pa.array(texts))
    got, table = scorer.adapted(read), np.asarray(scorer.table)
    want = []
    for text in texts:
        weights = model.weights.astype(np.float64)
        for word in [*lower_words(text), cm.END]:
            data, place = cm.symbols([word])
            cost = 0.0
            for i, (rows, sym) in enumerate(zip(np.stack(cm.context_rows(data, place, 0), axis=1), model.code[data])):
                gate = table[rows[-1]]
                for b in range(5):
                    sign, x = 2 * cm._BITS[sym, b] - 1, table[rows + cm._PATH[sym, b]] / cm.SCALE
                    p = 1 / (1 + np.exp(-sign * (weights[gate, :, b] @ x)))
                    cost -= np.log(p)
                    weights[gate, :, b] += cm.WEIGHT_RATE * sign * (1 - p) * x
                if sym == cm.ESCAPE:
                    odds = table[cm.FIRST_CELL[-1] + (int(cm._before(data, place, np.array([i]))[0]) << 8) + cm._PATH8[data[i]]] / cm.SCALE
                    cost += np.log1p(np.exp(-odds * (2 * cm._BITS8[data[i]] - 1.0))).sum()
            want.append(cost)
    assert np.allclose(got, want, rtol=1e-3, atol=1e-3)
    first = scorer.word_costs([w for t in texts for w in [*lower_words(t), cm.END]], 0)
    assert not np.allclose(got, first, rtol=1e-2)


def test_texts_of_like_length_are_scored_together_and_none_is_lost():
    from fieldproof.llm import context_mixing as cm

    texts = ["x" * (n * 7919 % 300) for n in range(100)] + ["y" * 5000, ""]
    batch = pa.RecordBatch.from_arrays([pa.array(range(102)), pa.array(texts)], ["n", "text"])
    parts = list(cm.abreast(batch, 1, 2000))
    assert sorted(i for p in parts for i in p.column(0).to_pylist()) == list(range(102))
    assert [len(t) for p in parts for t in p.column(1).to_pylist()] == sorted(map(len, texts))
    assert len(parts) > 5 and all(sum(map(len, p.column(1).to_pylist())) <= 2400 for p in parts[:-1])
    assert sum(p.num_rows for p in cm.abreast(batch.slice(0, 0), 1, 9)) == 0
