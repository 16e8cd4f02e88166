"""Top-k search, WARC packages, templates and order MinHash against brute force."""

import base64
import hashlib
import io
import random
import time
import tracemalloc
import zipfile

import numpy as np
from pyspark.sql import functions as F

from fieldproof.llm import order_minhash, template, topk, warc

VECTORS = "vec_id long, embedding array<float>"
PAGES = "page_id long, url string, html string"


def test_top_k(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.normal(0, 0.2, 8) * (rng.random(8) > 0.4)]) for i in range(300)]
    rows += [(i, rows[0][1]) for i in range(300, 360)] + [(400, None), (420, [0.1, None]), (440, [float("nan")] * 8), (460, [float("inf")] * 8), (None, [0.5] * 8), (480, []), (5, rows[5][1]), (5, rows[6][1]), (40, rows[40][1]), (60, rows[7][1])]
    found = topk.top_k(spark.createDataFrame([(*r, 0) for r in rows], VECTORS + ", score int"), F.col("vec_id") % 20 == 0, 7).collect()
    usable = [(i, [int(np.floor(64 * float(np.float32(x)))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    want = []
    for at, (q, u) in enumerate(usable):
        if q % 20 == 0:  # rows that repeat an id are queries and candidates of their own
            scores = sorted((-sum(a * b for a, b in zip(u, v)), i) for n, (i, v) in enumerate(usable) if n != at)[:7]
            want += [(q, n, i, -s) for n, (s, i) in enumerate(scores, 1)]
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in found) == sorted(want)


def test_top_k_with_few_rows(spark):
    rows = spark.createDataFrame([(0, [1.0]), (1, [2.0])], VECTORS)
    assert [(r.query_id, r.rank, r.vec_id, r.score) for r in topk.top_k(rows, F.col("vec_id") == 0).collect()] == [(0, 1, 1, 64 * 128)]
    assert topk.top_k(rows.limit(0), F.col("vec_id") == 0).count() == 0


def test_cells_are_scored_in_small_steps():
    """Scores of a step stay within a core's cache, and those beyond 31 bits stay whole."""
    rng = np.random.default_rng(3)
    ids, asked = np.arange(2000), np.arange(1500, 2100)
    for most in (60, 1 << 14, 1 << 15):  # the last two on either side of 31 bits
        rows, queries = (rng.integers(-most, most + 1, (n, 8)) * (rng.random((n, 8)) > 0.3) for n in (2000, 600))
        rows[0], queries[0] = most, most
        tracemalloc.start()
        found = topk.best_of_cell(ids, ids, rows, asked, asked, queries, 5)
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < 8e6
        scores = queries @ rows.T
        want = [(q, i, scores[n, i]) for n, q in enumerate(asked) for i in sorted((i for i in ids if i != q), key=lambda i: (-scores[n, i], i))[:5]]
        assert list(zip(found["query_id"], found["vec_id"], found["score"])) == want


def test_archives_round_trip(spark, monkeypatch):
    random.seed(2)
    bodies = [f"<p>{'ä' * random.randint(0, 50)}{i % 17}</p>" for i in range(200)] + [None, "", "x" * 300_000]
    rows = [(i, None if i % 50 == 7 else f"http://h/{i} ü\r\nx", b) for i, b in enumerate(bodies)]
    rows += [(None, "u", "only null"), (None, "u", bodies[0]), (3, "u", bodies[3]), (3, "t", bodies[3]), (3, "t", bodies[3])]
    rows += [(901, "u", "three rows"), (900, None, "three rows"), (900, None, "three rows")]
    pages = spark.createDataFrame([(*r, "z") for r in rows], PAGES + ", digest string")
    first = {}
    for i, _, b in rows:
        if i is not None:
            first[b or ""] = min(first.get(b or "", i), i)
    want, led = [], set()
    for i, _, b in rows:
        data = (b or "").encode()
        f = first.get(b or "")
        again = f is not None and (i != f or b in led)  # of rows that share the smallest page_id one is the response
        led |= {b} if i == f else set()
        want.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if again else "response", f if again else None, None if again else data))
    found = [(*r[:5], None if r[5] is None else bytes(r[5])) for r in warc.read(warc.archive(pages)).collect()]
    assert sorted(found, key=str) == sorted(want, key=str)
    assert warc.read(warc.archive(pages.limit(0))).count() == 0


def test_members_of_plain_and_zip64_packages():
    for wide in (False, True):
        data = io.BytesIO()
        with zipfile.ZipFile(data, "w", zipfile.ZIP_STORED) as package:
            with package.open("a/one", "w", force_zip64=wide) as member:
                member.write(b"first")
            package.writestr("two", b"second")
            package.writestr(zipfile.ZipInfo("packed"), b"z" * 100, zipfile.ZIP_DEFLATED)
            package.comment = b"note"
        raw = bytearray(data.getvalue())
        if wide:  # the end record with its numbers in a ZIP64 end record, as large packages have it
            at = raw.rfind(b"PK\x05\x06")
            n, size, start = int.from_bytes(raw[at + 10:at + 12], "little"), int.from_bytes(raw[at + 12:at + 16], "little"), int.from_bytes(raw[at + 16:at + 20], "little")
            head = [(44, 8), (45, 2), (45, 2), (0, 4), (0, 4), (n, 8), (n, 8), (size, 8), (start, 8)]
            end64 = b"PK\x06\x06" + b"".join(v.to_bytes(w, "little") for v, w in head)
            locator = b"PK\x06\x07" + (0).to_bytes(4, "little") + at.to_bytes(8, "little") + (1).to_bytes(4, "little")
            raw[at + 12:at + 20] = b"\xff" * 8
            raw[at:at] = end64 + locator
        raw = bytes(raw)
        found = warc.members(lambda o, n: raw[o:o + n], len(raw))
        assert {k: raw[o:o + n] for k, (o, n) in found.items()} == {"a/one": b"first", "two": b"second"}


def page(title, body, extra="", article="article"):
    return (f'<!DOCTYPE html><html><head><title>{title}</title><script>if (a < b) document.write("<p>no</p>")</script></head><body>'
            f'<nav><ul><li><a href="/">Home</a></li><li>News</li></ul></nav><div class="box">Best  offers of the week</div>'
            f'<{article}>{body}</{article}>{extra}<footer>&copy; site</footer></body></html>')


def test_main_text(spark):
    texts = [f"<h1>Title {i}</h1>" + "".join(f"<p>Body {i} &amp; part&nbsp;{j}\n <b>bold</b><br>x</p>" for j in range(i % 4 + 1)) + "<p>Same licence line.</p>" for i in range(8)]
    aside = '<aside>side</aside><div id="comments"><p>reader says</p></div><form>mail<input></form><div class="cookie-notice">ok?</div>'
    rows = [(i, f"https://h.example/{i}", page("t", t, aside)) for i, t in enumerate(texts)]
    rows += [(20 + i, f"https://plain.example/{i}", page("t", t, article="div")) for i, t in enumerate(texts)]
    rows += [(40, None, None), (41, "no host", ""), (42, "http://one.example/", "<p>left open <i>x</i><p>next<script>cut"), (43, "http://one.example/x", "<p>" + "long " * 200_000)]
    got = {r.page_id: r.text for r in template.extract(spark.createDataFrame([(*r, 1) for r in rows], PAGES + ", template int")).collect()}
    for i in range(8):
        want = [f"Title {i}", *(f"Body {i} & part {j} bold x" for j in range(i % 4 + 1)), "Same licence line."]
        assert got[i] == "\n\n".join(want)
        # Without an article the box goes as template of the host; the repeated line is in a list and stays.
        assert got[20 + i] == "\n\n".join(want)
    assert got[40] == got[41] == "" and got[42] == "left open x\n\nnext" and len(got[43]) == 5 * 200_000 - 1
    assert template.extract(spark.createDataFrame([], PAGES)).count() == 0


def _brute_templates(pages):
    """Texts that are template, from whole vectors, orders and pairs of classes compared in plain loops."""
    runs = [[(b.path, b.text) for b in template.blocks(p)] for p in dict.fromkeys(pages)]
    if len(runs) < template.LEAST_PAGES:
        return set()
    tokens = [[t for path, text in run for t in ((path, None), (path, text))] for run in runs]
    vector = {t: tuple(run.count(t) for run in tokens) for run in tokens for t in run}
    wide = {t: v for t, v in vector.items() if sum(map(bool, v)) >= max(template.LEAST_PAGES, template.SHARE * len(runs))}
    classes = {v: {t for t in wide if wide[t] == v} for v in wide.values()}
    classes = {v: ts for v, ts in classes.items() if len(ts) >= 2}
    bad = set()
    for v, ts in classes.items():
        befores = {t: set() for t in ts}
        for run in tokens:
            mine = [t for t in run if t in ts]
            first = list(dict.fromkeys(mine))
            if mine and mine != first * (len(mine) // len(first)):
                bad |= ts
            for before, t in zip([None, *first], first):
                befores[t].add(before)
        bad |= {t for t, b in befores.items() if len(b) > 1}
    steady = {v: ts - bad for v, ts in classes.items() if len(ts - bad) >= 2}
    even = {t for t in wide if t[1] is None and t not in bad and len({n for n in wide[t] if n}) == 1}
    return {t for ts in steady.values() for t in ts if t[1] is not None and (t[0], None) in even}


def _host_pages(rng, n):
    """Pages of one host without <article>: constant boxes in one order, a list of any length, and texts of their own."""
    boxes = [f"<div id=box{k}><b>Box</b> {k} says the same.</div>" for k in "abcde"]
    out = []
    for i in range(n):
        items = "".join(f"<li>{rng.choice(['Common item', f'Item {i} {j}'])}</li>" for j in range(rng.randint(1, 4)))
        own = f"<section><p>Own text {i} {rng.random()}</p></section>"
        parts = [boxes[0], own, boxes[1], f"<ul>{items}</ul>", boxes[2]]
        if rng.random() < 0.9:
            parts.append(boxes[3])
        out.append("<html><body>" + "".join(parts) + "</body></html>")
    return out


def test_templates_against_plain_loops(spark):
    rng = random.Random(7)
    hosts = {f"h{k}.example": _host_pages(rng, n) for k, n in enumerate((1, 2, 3, 5, 12, 20))}
    hosts["h3.example"] += [hosts["h3.example"][0]] * 40  # copies count once
    # Two boxes that change places are no template, nor is what follows them directly.
    hosts["swap.example"] = [
        f"<div id=a>First</div><p>Own {i}</p>" + "".join(("<div id=b>Left</div>", "<div id=c>Right</div>")[:: 1 - 2 * (i % 2)]) + "<div id=d>Next</div><div id=e>Last</div>"
        for i in range(9)
    ]
    rows = [(i, f"https://{h}/{i}", p) for i, (h, p) in enumerate((h, p) for h, ps in hosts.items() for p in ps)]
    found = {r.host: set(r.template) for r in template.templates(spark.createDataFrame(rows, PAGES)).collect()}
    for host, pages in hosts.items():
        assert found.get(host, set()) == {template._token(path, text) for path, text in _brute_templates(pages)}, host
    assert not found.get("h1.example") and found["h5.example"] and len(found["swap.example"]) == 2


def test_hosts_without_article_differ_by_template_alone(spark):
    lines = [f"<div id=a>Shared words</div><div id=b>Story {i}</div><div id=c>More shared words</div>" for i in range(6)]
    rows = [(i, f"http://many.example/{i}", p) for i, p in enumerate(lines)] + [(10, "http://single.example/", lines[0])]
    got = {r.page_id: r.text for r in template.extract(spark.createDataFrame(rows, PAGES)).collect()}
    assert [got[i] for i in range(6)] == [f"Story {i}" for i in range(6)]
    assert got[10] == "Shared words\n\nStory 0\n\nMore shared words"


def test_template_inside_and_outside_articles(spark):
    story = lambda i: f"<h1>Title {i}</h1><p>Story {i} goes on for a while and says {i} things.</p>"
    share = "<div id=x>Tell friends</div>"
    rows = [(i, f"http://a.example/{i}", f"<article>{story(i)}{share}</article>") for i in range(5)]
    # Near copies: the text that all of them declare is no template.
    copy = "<article><h1>One title</h1><p>The same story, told at length in every copy of it.</p><p>Version {}</p></article>"
    rows += [(10 + i, f"http://b.example/{i}", copy.format(i)) for i in range(5)]
    # A teaser in <article> does not stand for the text outside it.
    rows += [(20, "http://c.example/", f"<div><p>{'Main text. ' * 20}</p></div><article><p>Teaser</p></article>")]
    rows += [(21, "http://d.example/", "<article><p class='related-work'>Earlier work.</p><p class=ad>Buy</p><div class='related-posts'>More</div><p>End.</p></article>")]
    got = {r.page_id: r.text for r in template.extract(spark.createDataFrame(rows, PAGES)).collect()}
    for i in range(5):
        assert got[i] == f"Title {i}\n\nStory {i} goes on for a while and says {i} things."
        assert got[10 + i] == f"One title\n\nThe same story, told at length in every copy of it.\n\nVersion {i}"
    assert got[20] == ("Main text. " * 20).strip() + "\n\nTeaser" and got[21] == "Earlier work.\n\nEnd."


def test_nesting():
    outer, inner, crossing = {1: 10, 2: 10, 3: 10}, {4: 20, 5: 20}, {6: 30, 7: 30}
    kinds = outer | inner | crossing
    found = template.nesting([1, 4, 9, 5, 4, 5, 2, 6, 3, 7], kinds)
    assert found[4] == (0, 1, False) and found[5] == (4, 1, False) and found[3] == (2, 0, False)
    assert found[6][2] and found[7][2]  # open when the outer class went on
    assert template.nesting([1, 4, 5, 2, 4, 5, 3], kinds)[4][2]  # two slots
    assert template.nesting([4, 5, 5, 4], kinds)[4][2]  # two orders


def test_broken_markup_is_read_in_one_pass():
    pieces = ["<script ", '<a b="', "<a \">x<a '>", "<!", "<a<", "<!--", "<div>", "</x>", "<div>" * 3 + "</p>", '<p class="a', "</script"]
    for piece in pieces:
        for end in ("", ">", '">', "</div>"):
            page, start = piece * (1_000_000 // len(piece)) + end, time.process_time()
            template.blocks(page)
            assert time.process_time() - start < 5, (piece, end)
    text = lambda page: [b.text for b in template.blocks(page)]
    assert text("a < b <3 <p>c</p") == ["a < b <3", "c</p"]
    assert text('<p a="x>y">one</p><p a="two>three</p><p>four') == ["one", "three", "four"]
    assert text("<script a='>'>x</p></SCRIPT ><p>in<!-- c > -->side<p>x<!-- open <p>y") == ["inside", "x"]
    assert text("<custom-script>kept</custom-script>") == ["kept"]


def test_edited_texts(spark):
    random.seed(4)
    rows = [(i * 3, "".join(random.choices("abcdeé 🙂", k=random.choice([0, 1, 9, 10, 40, 900])))) for i in range(1500)]
    rows += [(None, "none"), (9000, None), (9001, "same" * 400), (9002, "same" * 400), (9003, "z" * 1_100_000)]
    random.shuffle(rows)
    found = order_minhash.edited_pairs(spark.createDataFrame([(*r, "k") for r in rows], "doc_id long, text string, key string")).collect()
    ordered = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is not None, r[0] or 0))
    want = {}
    for (i, t), (_, n) in zip(ordered, ordered[1:] + ordered[:1]):
        half = len(t) // 2
        edited = t[:len(t) - half] + n[:half]
        a, b, c = (order_minhash.signature(x) for x in (t, edited, n))
        want[i] = (len(t), hashlib.sha256(edited.encode()).hexdigest(), order_minhash.likeness(a, b), order_minhash.likeness(a, c), a.astype(">u2").tobytes().hex())
    assert {r.doc_id: (r.n_chars, r.edited_sha256, r.near_edited, r.near_next, r.fingerprint) for r in found} == want
    by = {r.doc_id: r for r in found}
    assert by[9001].near_next == 1.0 and by[9001].fingerprint == by[9002].fingerprint


def test_no_row_is_lost_with_ids_beyond_doubles(spark, monkeypatch):
    monkeypatch.setattr(order_minhash, "RANGE_ROWS", 20)
    rng = random.Random(12)
    rows = sorted((rng.getrandbits(63) * rng.choice((1, -1)), f"text of row {i}") for i in range(300))
    found = order_minhash.edited_pairs(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = {}
    for (i, t), (_, n) in zip(rows, rows[1:] + rows[:1]):
        half = len(t) // 2
        want[i] = hashlib.sha256((t[:len(t) - half] + n[:half]).encode()).hexdigest()
    assert len(found) == len(rows) and {r.doc_id: r.edited_sha256 for r in found} == want


def test_one_row_and_none(spark):
    one = order_minhash.edited_pairs(spark.createDataFrame([(5, "alone in the table")], "doc_id long, text string")).collect()
    assert len(one) == 1 and one[0].near_next == 1.0
    assert order_minhash.edited_pairs(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_likeness_follows_edits():
    random.seed(9)
    text = " ".join("".join(random.choices("abcdefgh", k=6)) for _ in range(300))
    words = text.split()
    moved = " ".join(words[150:] + words[:150])
    few = list(words)
    for i in random.sample(range(300), 10):
        few[i] = "zzzzzz"
    like = lambda other: order_minhash.likeness(order_minhash.signature(text), order_minhash.signature(other))
    assert like(text) == 1.0 and like(" ".join(few)) > like(" ".join(words[:150] + ["q" * 6] * 150)) > like("unlike " * 300)
    # The same k-mers in another order agree less than set overlap alone would say.
    assert like(moved) < 0.8
