"""Each operator against brute force, a library or SQL, on small tables with all the odd rows."""

from __future__ import annotations

import hashlib
import random
import re
import textwrap
import time
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from landfall.llm import binary, common, components, html, licenses, mixing, neardup, quality, queries, repeats, sql, tokens, vectors, warc

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, kept string, size int, ids string"


def words(rng, n):
    return [rng.choice("abcdefgh") + rng.choice(["er", "ing", "ou", "a", "th"]) + str(rng.randrange(40)) for _ in range(n)]


def edited(rng, base, n):
    out = list(base)
    for _ in range(n):
        out[rng.randrange(len(out))] = f"edit{rng.randrange(10**9)}"
    return out


def corpus():
    """Nulls, empty and long texts, ties, repeated rows, copies, a family of near copies and shared passages."""
    rng = random.Random(3)
    base, passage = words(rng, 120), words(rng, 60)
    texts = [None, "", " \n\t ", "one", "two words", "a\n\nb", "x " * 4000, "Menu | Home | About | Contact\nSome text here, and more of it.", "%%% a### b*** c$$$"]
    texts += [" ".join(base)] * 3 + [" ".join(edited(rng, base, k % 9)) for k in range(60)]
    texts += [" ".join(words(rng, 80) + passage + words(rng, rng.randrange(90))) for _ in range(25)]
    texts += [". ".join(words(rng, rng.randrange(1, 200))) + ".\nAll rights reserved." for _ in range(25)]
    texts += ["Café déjà\x0bvu\x1c " + "naïve " * 70, "日本語のテキスト。" * 30, "a<|endoftext|>b <|startoftext|> c"]
    rows = [(i, t, "en", None if i % 11 == 0 else f"s{i % 4 if i % 3 else 0}", 7, "clash", 1, "x") for i, t in enumerate(texts)]
    return rows + [rows[30], (None, "a row without an id " * 20, None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), DOCS).persist()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def duck(docs):
    con = duckdb.connect()
    con.register("documents", docs.toArrow())
    return con


def rows_of(df, *names):
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=str)


def test_quality_is_sql(docs, none):
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    got = rows_of(quality.line_first_rules(docs), *names)
    want = duck(docs).execute(sql.op1_quality_rules.replace("select doc_id, n_words", "select doc_id, n_words")).fetchall()
    assert got == sorted(want, key=str)
    assert quality.line_first_rules(none).count() == 0
    kept = quality.line_first_rules(docs).filter("kept")
    assert kept.count() == sum(bool(r[-1]) for r in want)


def test_quality_cleans_lines(spark):
    text = "Home | News | About | Contact\n" + ". ".join(words(random.Random(1), 90)) + "."
    row = quality.line_first_rules(spark.createDataFrame([(1, text)], "doc_id int, text string")).first()
    assert row.kept and row.clean_text == text.split("\n")[1] and row.lost_percent > 0


def test_repeated_words_by_hand(spark):
    df = spark.createDataFrame([("a b c x a b c",), ("a a a a",), ("a b",), ("a b c d a b",)], "text string")
    assert [r.n_repeat_words for r in quality.line_first_rules(df).collect()] == [6, 4, 0, 0]


def test_bpe_is_the_library(docs, none):
    lib = Tokenizer.from_file(BYTE)
    for r in tokens.ids_array(tokens.byte_bpe(docs, BYTE)).join(docs.select("doc_id", "text").distinct(), "doc_id").collect():
        want = lib.encode(r.text or "", add_special_tokens=False).ids
        assert r.ids == want and r.decoded == lib.decode(want, skip_special_tokens=False)
    digest = queries.token_digests(docs, BYTE).filter("doc_id = 0").first()
    assert (digest.n_tokens, digest.ids_sha256, digest.decoded_sha256) == (0, hashlib.sha256(b"").hexdigest(), hashlib.sha256(b"").hexdigest())
    assert tokens.byte_bpe(none, BYTE).count() == 0


def test_bpe_random_texts():
    lib, ours, rng = Tokenizer.from_file(BYTE), tokens.loaded(BYTE), random.Random(1)
    parts = ["a", "ab", "the", "ing", " ", "  ", "\n", "\t", "é", "’", "'s", "1", "23", ".", "!!", "aaa", "日", "\xa0", "\x1c", "\x85", "_", "Ⅷ", "²", "<|endoftext|>", "\U0001f600"]
    for _ in range(2000):
        text = "".join(rng.choices(parts, k=rng.randint(1, 20)))
        assert np.frombuffer(ours.encode(text), "<u4").tolist() == lib.encode(text, add_special_tokens=False).ids, text


def plain_dice(a, b):
    """The coefficient from its definition: normalised words, pairs of neighbours as a multiset."""
    def pairs(text):
        lines = [line for line in text.split("\n") if not re.match(r"\W*(copyright|\(c\)|©)", line, re.I)]
        words = re.findall(r"[^\W_]+(?:[.-][^\W_]+)*", "\n".join(lines).casefold())
        return list(zip(words, words[1:])) if len(words) > 1 else [(w, "") for w in words]
    x, y = pairs(a), pairs(b)
    total, rest = len(x) + len(y), list(y)
    for pair in x:
        if pair in rest:
            rest.remove(pair)
    return 2 * (len(y) - len(rest)) / total if total else 0.0


def test_licenses(docs, none, spark):
    scanner = licenses.Scanner(licenses.TEMPLATES, licenses.DICE)
    for name, texts in licenses.TEMPLATES.items():
        for text in texts:
            assert scanner.best(text.upper())[1] == name
            assert max(scanner.scan("Words before, of all kinds.\n" + text), key=lambda x: x[1])[0] == name
    short = [(n, t) for n, ts in licenses.TEMPLATES.items() for t in ts if len(t) < 400]
    few = spark.createDataFrame([(5000 + i, f"Before it.\n{t} And after it.") for i, (_, t) in enumerate(short)] + [(9000, None), (9001, "")], "doc_id bigint, text string")
    both = docs.select("doc_id", "text").unionByName(few)
    for row in licenses.license_scan(both).join(both.distinct(), "doc_id").collect():
        best = max((plain_dice(u, t), n) for u in {row.text or "", *(row.text or "").split("\n")} for n, t in short)[0]
        assert row.dice >= (best - 1e-9 if best >= licenses.DICE else 0.0)
        if 5000 <= row.doc_id < 9000:
            assert (row.license, row.dice) == (short[row.doc_id - 5000][0], 1.0)
        else:
            assert row.dice in (0.0, pytest.approx(best))
    clash = docs.withColumns({"license": F.lit("own"), "dice": F.lit("own"), "line": F.lit("own")})
    assert licenses.license_scan(clash).schema == licenses.license_scan(docs).schema
    assert licenses.license_scan(none).count() == 0


def test_licenses_tell_versions_apart():
    """Each text names itself, versions without a template name nothing of another version, and the system's own copies are found."""
    scanner = licenses.Scanner(licenses.TEMPLATES, licenses.DICE)
    best = lambda text: max(scanner.scan(text), key=lambda x: x[1], default=(None,))[0]
    for name, text in licenses.TEXTS.items():
        assert best(text) == name
    gpl = "This program is free software; you can redistribute it and/or modify it under the terms of the GNU {} Public License as published by the Free Software Foundation; either version {} of the License, or (at your option) any later version."
    for kind, version, want in (("General", "2", "GPL-2.0"), ("General", "3", "GPL-3.0"), ("Lesser General", "3", "LGPL-3.0"), ("Affero General", "3", "AGPL-3.0"), ("Lesser General", "2.1", "LGPL-2.1")):
        assert best("# " + "\n# ".join(textwrap.wrap(gpl.format(kind, version), 60))) == want
    assert best("Released under the BSD 2-Clause License.") == "BSD-2-Clause" and best("Released under the BSD 4-Clause License.") is None
    assert best("This work is licensed under a Creative Commons Attribution 3.0 Unported License.") == "CC-BY-3.0"
    assert best("Licensed under CC BY 9.9.") is None
    for file, want in (("GPL-2", "GPL-2.0"), ("GPL-3", "GPL-3.0"), ("LGPL-2.1", "LGPL-2.1"), ("LGPL-3", "LGPL-3.0"), ("Apache-2.0", "Apache-2.0"), ("MPL-2.0", "MPL-2.0"), ("CC0-1.0", "CC0-1.0"), ("BSD", "BSD-3-Clause")):
        path = Path("/usr/share/common-licenses", file)
        if path.exists():
            assert best(path.read_text()) == want, file


def test_licenses_in_any_run_of_words():
    """Wrapped over lines, inside a line and as a full text; the best run is that of brute force."""
    scanner = licenses.Scanner(licenses.TEMPLATES, licenses.DICE)
    assert scanner.scan("This project is released under the MIT License.")[0] == ("MIT", 1.0, 1)
    assert scanner.scan("© 2020 A. Person. Licensed under CC BY 4.0.")[0][0] == "CC-BY-4.0"
    for name, text in licenses.TEXTS.items():
        lines = textwrap.wrap(text, 70, break_on_hyphens=False)
        for prefix in ("", " * ", "# "):
            full = "\n".join(["A file.", "Copyright (c) 2020 A. Person", "", *(prefix + line for line in lines), "", "And then other words."])
            (score, at), = [(s, at) for n, s, at in scanner.scan(full) if n == name]
            assert score > 0.97 and at == 4, name
    for name, notices in licenses.TEMPLATES.items():
        wrapped = "Some words before it. " + notices[0] + " And words after."
        assert (name, 1.0, 2) in scanner.scan("First.\n" + "\n# ".join(textwrap.wrap(wrapped, 30, break_on_hyphens=False, break_long_words=False)).replace("\n", " ", 1)), name
    rng = random.Random(6)
    small = {"A": ["a b c d e"], "B": ["a b a b c a b", "d d d"], "C": ["e"]}
    scanner = licenses.Scanner(small, 0.7)
    for _ in range(300):
        text = rng.choices("abcdef", k=rng.randrange(1, 25))
        runs = {" ".join(text[i:j]) for i in range(len(text)) for j in range(i + 1, len(text) + 1)}
        best = min((-licenses.dice(licenses.bigrams(u), licenses.bigrams(t)), n) for u in runs for n, ts in small.items() for t in ts)
        found = min(((-s, n) for n, s, _ in scanner.scan(" ".join(text))), default=(0.0, None))
        assert found == (best if best[0] <= -0.7 else (0.0, None))


def test_vectors_is_brute_force(spark):
    rng = np.random.default_rng(5)
    centre = rng.normal(size=(6, 16))
    rows = [(i, (centre[i % 6] + rng.normal(scale=0.22, size=16)).tolist(), None if i == 7 else i % 2) for i in range(150)]
    rows += [(200 + i, centre[0].tolist(), 0) for i in range(30)]
    rows += [(300, None, 0), (301, [0.0] * 16, 0), (302, [float("nan")] + [1.0] * 15, 0), (303, [], 0), (304, [None] + [1.0] * 15, 0), (305, [1.0, 2.0], 0), (None, centre[0].tolist(), 0)]
    rows += [(306, [0.0, 1.0], 0)] * 3 + [(307, [0.0, 1.0], 0), (200, centre[0].tolist(), 0), (400, centre[1].tolist(), 1), (400, centre[2].tolist(), 0), (401, centre[3].tolist(), 1)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int")
    unit = set()
    for i, v, lab in df.collect():
        if i is not None and v and lab is not None and all(c is not None and np.isfinite(c) for c in v) and any(v):
            unit.add((i, lab, tuple(v)))
    one = {u: np.array(u[2]) / np.linalg.norm(u[2]) for u in unit}
    links = [(a, b) for a in unit for b in unit if a != b and a[1] == b[1] and len(a[2]) == len(b[2]) and one[a] @ one[b] >= vectors.COSINE]
    count, top = Counter(a[0] for a, _ in links), components.forest((a[0], b[0]) for a, b in links)
    want = sorted([(i, count[i], top.get(i, i), top.get(i, i) == i) for i, _, _ in rows if i is not None] + [(None, 0, None, True)], key=str)
    assert rows_of(vectors.near_vectors(df), "vec_id", "n_links", "component_id", "kept") == want
    assert vectors.near_vectors(df.limit(0)).count() == 0
    twice = spark.createDataFrame([(5, [1.0, 0.0], 0)] * 2, "vec_id bigint, embedding array<float>, label int")
    assert rows_of(vectors.near_vectors(twice), "vec_id", "n_links") == [(5, 0)] * 2


def test_interval_join_leaves():
    rng = np.random.default_rng(2)
    a = rng.normal(size=(700, 3))
    a /= np.linalg.norm(a, axis=1)[:, None]
    found = {(int(i), int(j)) for p in vectors.links_between(a, a, a, a, 0.99, True) for i, j in zip(*p)}
    assert found == {(i, j) for i, j in zip(*np.nonzero(np.triu(a @ a.T >= 0.99, 1)))}


def test_warc(spark):
    big = "<html>" + "é" * 800 + "\r\n\r\nWARC/1.1\r\n" + "</html>"
    ends = [(2**63 - 1, "e", "x\r\n", "c"), (10**14, "e", "\r\n\r\n", "c"), (-5, "e", "a\r\n\r", "c"), (2**62, "e", "\n", "c"), (11, "e", "\r\n\r\n\r\n" * 3, "c"), (12, "long", "y" * 3_000_000 + "\r\n\r\n", "c")]
    pages = ends + [(1, "http://b.example.com/x?q=1", big, "c"), (2, "HTTPS://www.a.example.com", big, "c"), (3, None, None, None), (4, "http://a.example.com/", "", "c"), (5, "x\r\ny", "short", "c"), (6, "http://b.example.com/x?q=1", "short", "c"), (7, "u", big + "!", "c")]
    df = spark.createDataFrame(pages + [pages[0]], "page_id bigint, url string, html string, payload string")
    path = common.scratch(spark, "warc")
    warc.write_archives(warc.with_records(df), path)
    got = warc.read_archives(spark, path).collect()
    assert len(got) == 14
    for r in got:
        assert len(r.captured) == 20
        text = next(p[2] for p in pages if p[0] == r.page_id) or ""
        assert (r.payload_bytes, r.payload_digest) == (len(text.encode()), hashlib.sha1(text.encode()).hexdigest())
        assert (r.record_type, r.refers_to) == (("revisit", 2) if r.page_id == 1 else ("response", None))
        assert bytes(r.payload) == (b"" if r.record_type == "revisit" else text.encode())
    index = warc.merged_index(warc.read_archives(spark, path)).collect()
    keys = [(r.url_key, r.captured, r.page_id) for r in index]
    assert keys == sorted(keys)
    empty = common.scratch(spark, "warc")
    warc.write_archives(warc.with_records(df.limit(0)), empty)
    assert warc.read_archives(spark, empty).count() == 0


def test_warc_histories_over_ranges(spark):
    """Each capture knows the one before, whatever range that is in."""
    df = spark.createDataFrame([(i, f"http://{'hot' if i % 4 else f'h{i % 40}'}.example.com/", f"page {i}") for i in range(400)] + [(None, "http://hot.example.com/", "x")], "page_id bigint, url string, html string")
    path = common.scratch(spark, "warc")
    warc.write_archives(warc.with_records(df.repartition(5)), path)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        index = warc.merged_index(warc.read_archives(spark, path))
        got = index.withColumn("task", F.spark_partition_id()).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len({r.task for r in got}) > 1 and len(got) == 401
    before = None
    for r in got:
        assert r.previous == (before.page_id if before and before.url_key == r.url_key else None)
        before = r
    keys = [(r.url_key, r.captured, r.page_id is not None, r.page_id or 0) for r in got]
    assert keys == sorted(keys)


def test_loser_tree():
    rng = random.Random(4)
    for k in range(0, 9):
        runs = [sorted(rng.randrange(50) for _ in range(rng.randrange(20))) for _ in range(k)]
        assert list(warc.LoserTree([iter(r) for r in runs], lambda x: x)) == sorted(x for r in runs for x in r)


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p>";</script></head><body><header>Head</header>
<nav><ul><li><a href="/">Home</a></li></ul></nav><div class="cookie-notice">We use cookies</div><div class="ad">Buy</div>
<article><h1>A &amp; B</h1><p>First&nbsp;one,
  with <b>bold</b> words &lt;here&gt;.<p>Second &#233;<br>line</p><form>Name <input></form><ul><li>x<li>y</ul>
<div class="comments"><p>I think so</p></div></article><aside>More</aside><footer>&copy; me</footer>"""


def extracted(spark, rows):
    return {r.page_id: r.text for r in html.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}


def alone(page):
    stream, blocks = html.read(page)
    return html.main_text(stream, stream, blocks)


def test_html(spark):
    assert alone(PAGE) == "A & B\nFirst one, with bold words <here>.\nSecond é line\nx\ny"
    assert alone("<p>no article</p><nav>n</nav>tail") == "no article\ntail"
    assert alone("<a title='it's'>x</a><p title=\"a>b\">y<p t=\"open>z") == "x\ny\nz"
    rows = [(1, "http://h.example.com/1", PAGE, "c"), (2, None, None, "c"), (3, "x", "", "c"), (3, "x", "", "c")]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string, text string")
    got = {r.page_id: r for r in html.extract(df).collect()}
    assert got[1].text.startswith("A & B") and got[1].n_chars == len(got[1].text) and (got[2].text, got[2].n_chars) == ("", 0)
    assert html.extract(df).count() == 4 and html.extract(df.limit(0)).count() == 0


def test_html_article_loses_nothing(spark):
    """What all articles of a host share stays, on hosts of every size."""
    rows = [(100 * n + i, f"http://h{n}.example.com/", f"<nav>Menu</nav><article><h1>News</h1><p>Only here {i}</p><p>Shared closing paragraph</p></article>") for n in (1, 2, 9, 10, 30) for i in range(n)]
    assert extracted(spark, rows) == {i: f"News\nOnly here {i % 100}\nShared closing paragraph" for i, _, _ in rows}


def test_wrappers():
    a = html.fold(html.parse("<article><p>1</p><p>2</p></article>")[0])
    b = html.fold(html.parse("<article><h1>t</h1><p>1</p></article>")[0])
    assert a == ["article", "(p #a /p)+", "/article"]
    assert "(h1)?" in html.align(a, b)
    stream, blocks = html.read("<article><h1>t</h1><p>1</p></article>")
    assert [(t, kind) for t, _, kind in html.placed("\x1f".join(html.align(a, b)), stream, blocks)] == [("t", "a"), ("1", "a")]


def test_html_slots_of_the_wrapper(spark):
    """Without an article, a text is template in the slot where all pages have it and not in another."""
    body = [f"<div>{'<p>Read our guide</p>' * (i != 5)}<h2>Title {i}</h2><p>{'Read our guide' if i == 3 else f'Only here {i}'}</p>{'<p>and here X</p>'.replace('X', str(i)) * (i % 2)}</div>" for i in range(24)]
    got = extracted(spark, [(i, "http://k.example.com/", b) for i, b in enumerate(body)])
    assert got[3] == "Title 3\nRead our guide\nand here 3" and got[5] == "Title 5\nOnly here 5\nand here 5" and got[6] == "Title 6\nOnly here 6"
    rows = [(i, "http://p.example.com/", f"<h1>Site</h1><div>Text {i}</div>" + "<ul><li>a<li>b</ul>" * (i % 2)) for i in range(40)]
    got = extracted(spark, rows + [(90, "http://one.example.com/", "<p>a</p>"), (91, "http://same.example.com/", "<p>b</p>"), (92, "http://same.example.com/", "<p>b</p>")])
    assert got[0] == "Text 0" and got[1] == "Text 1" and (got[90], got[91], got[92]) == ("a", "b", "b")


def test_html_templates_with_known_slots(spark):
    """Pages drawn from a template of constant, varying, optional and repeated parts; the truth is what was drawn."""
    rng = random.Random(12)
    rows, want = [], {}
    for host in range(6):
        before, after = [f"<div><h4>top {host} {k}</h4></div>" for k in range(rng.randrange(3))], [f"<table><tr><td>end {host} {k}</table>" for k in range(rng.randrange(3))]
        for page in range(rng.randrange(2, 14)):
            key = 100 * host + page
            parts = [f"title {key}", *[f"item {key} {k}" for k in range(rng.randrange(3))], "always said", *[f"text {key} {k}" for k in range(rng.randrange(1, 5))]]
            items = [p for p in parts if p.startswith("item")]
            shown = [f"<h2>{parts[0]}</h2>", "<ul>" + "".join(f"<li>{p}" for p in items) + "</ul>" if items else "", "<pre>always said</pre>", *[f"<p>{p}</p>" for p in parts if p.startswith("text")]]
            rows.append((key, f"http://h{host}.example.com/", "".join(before + shown + after)))
            want[key] = "\n".join(parts)
    assert extracted(spark, rows) == want


def test_html_many_shapes(spark, monkeypatch):
    """More shapes on a host than one task aligns."""
    monkeypatch.setattr(html, "PART", 4)
    rng = random.Random(13)
    rows = [(i, "http://h.example.com/", "<div>Site</div>" + "".join(rng.choice([f"<p>p{i}.{k}</p>", f"<ul><li>l{i}.{k}</ul>", f"<h3>h{i}.{k}</h3>"]) for k in range(1, 7))) for i in range(60)]
    seen = html.read_pages(spark.createDataFrame(rows, "page_id bigint, url string, html string"))
    (row,) = html.wrappers(seen).collect()
    assert row.n == 60
    got = extracted(spark, rows)
    assert all(got[i].startswith(page.split(">")[3].split("<")[0]) and "Site" not in got[i] for i, _, page in rows)


def test_html_wrapper_of_any_parts(spark, monkeypatch):
    """The number of streams that meet in a task, or their length, changes no result."""
    rng = random.Random(14)
    rows = [(i, "http://h.example.com/", "<div>Site</div>" + "".join(rng.choice(["<p>p</p>", "<ul><li>l</ul>", "<h3>h</h3>", "<pre>x</pre>"]) for _ in range(9))) for i in range(60)]
    seen = html.read_pages(spark.createDataFrame(rows, "page_id bigint, url string, html string")).persist()
    found = set()
    for part in (2, 5, 256):
        monkeypatch.setattr(html, "PART", part)
        found |= {(r.wrapper, r.n) for r in html.wrappers(seen).collect()}
    assert len(found) == 1
    long = [rng.choice("abc") for _ in range(2000)]
    assert "b" in html.align(["a", "b"], ["b", "c"]) and html.align(long, long) == long
    extra = html.align(long, [*long[:700], "new", *long[700:]])
    assert [s for s in extra if s != "(new)?"] == long and extra.count("(new)?") == 1


def test_html_takes_time_in_proportion():
    """Unclosed tags, deep nesting and open quotes."""
    for make in (lambda n: "<a " * n, lambda n: "<!x" * n, lambda n: "<div>" * n + "x", lambda n: '<p t="' * n + ">", lambda n: "<p>x" * n, lambda n: "<ul><li>" * n + "y", lambda n: "</b>" * n + "<b>" * n):
        seconds = []
        for n in (4000, 16000):
            began = time.process_time()
            html.parse(make(n))
            seconds.append(time.process_time() - began)
        assert seconds[1] < 10 * seconds[0] + 0.5


def test_html_names_inside_the_article():
    """Inside an article only whole names count, never ids of headings, and its own header keeps its headings."""
    page = """<div class="site-header"><h1>Site</h1></div><article class="post-with-sidebar"><header><nav><h2>Menu</h2></nav><h1>Title <b>one</b></h1>May 1</header>
<div class="entry-header"><h1>Title two</h1></div><div class="big header"><h3 class="header">Title three</h3><p>By me</p></div><h2 id="related-work">Related work</h2><h2 id="comments">On comments</h2>
<section id="notice-period"><p>A month</p></section><table class="form-factor"><tr><td>Small</table><div class="x share">Share</div><div id="comments"><h2>Said</h2></div><div class="ad">Buy</div><p>End</p></article>"""
    assert alone(page).split("\n") == ["Title one", "Title two", "Title three", "Related work", "On comments", "A month", "Small", "End"]


def test_token_files(spark, docs, none):
    path = common.scratch(spark, "ids")
    binary.write_ids(docs, path, WORD, end_id=2)
    got = [tuple(r) for r in binary.checksums(binary.read_ids(spark, path)).collect()]
    lib, at, want = Tokenizer.from_file(WORD), 0, []
    for key, text in sorted(((r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()), key=lambda x: (x[0] is not None, x[0] or 0)):
        ids = [*lib.encode(text or "", add_special_tokens=False).ids, 2]
        want.append((key, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert sorted(got, key=lambda x: x[1]) == want
    assert "PushedFilters: [IsNotNull(doc_id), EqualTo(doc_id,5)]" in spark.read.orc(path).filter("doc_id = 5")._jdf.queryExecution().toString()
    empty = common.scratch(spark, "ids")
    binary.write_ids(none, empty, WORD, end_id=2)
    assert binary.read_ids(spark, empty).count() == 0


def test_token_files_skip_stripes(spark):
    """Row indexes and Bloom filters stand in the files, and a look-up by id reads one row group."""
    docs = spark.range(60_000).selectExpr("id * 3 as doc_id", "concat('some words of number ', id) as text").repartition(5)
    path = common.scratch(spark, "ids")
    binary.write_ids(docs.withColumn("ids", F.lit("clash")), path, WORD, end_id=2)
    jvm = spark._jvm
    files = sorted(Path(path).glob("*.orc"))
    last = -1
    for file in files:
        options = jvm.org.apache.orc.OrcFile.readerOptions(spark._jsc.hadoopConfiguration())
        reader = jvm.org.apache.orc.OrcFile.createReader(jvm.org.apache.hadoop.fs.Path(str(file)), options)
        assert reader.getRowIndexStride() == 10_000 and reader.getStripes().size() >= 1
        columns = reader.getSchema().getMaximumId() + 1
        every = spark.sparkContext._gateway.new_array(jvm.boolean, columns)
        for k in range(columns):
            every[k] = True
        index = reader.rows().readRowIndex(0, every, every)
        assert index.getRowGroupIndex()[1].getEntryCount() >= 1 and index.getBloomFilterIndex()[1].getBloomFilterCount() >= 1
        ids = [r.doc_id for r in spark.read.orc(str(file)).collect()]
        assert ids == sorted(ids) and ids[0] > last
        last = ids[-1]
    found = spark.read.orc(path).filter("doc_id = 90000")
    assert found.count() == 1 and spark.read.orc(path).filter("doc_id = 90001").count() == 0
    plan = found.select("doc_id", "n_tokens")
    plan.collect()
    executed = plan._jdf.queryExecution().executedPlan()
    leaf = executed.collectLeaves().head()
    assert leaf.metrics().apply("numOutputRows").value() <= 10_000


def test_token_files_of_another_tokenizer(spark, docs):
    """Files that the short way does not hold for: whole texts go to the library."""
    path = common.scratch(spark, "ids")
    binary.write_ids(docs, path, BYTE, end_id=2)
    lib = Tokenizer.from_file(BYTE)
    for r in binary.read_ids(spark, path).join(docs.select("doc_id", "text").distinct(), "doc_id").collect():
        assert r.ids == [*lib.encode(r.text or "", add_special_tokens=False).ids, 2]
    with pytest.raises(ValueError):
        tokens.PrefixEncoder(WORD)


def test_words_are_remembered_within_bounds():
    made = []
    kept = common.Kept(lambda keys: (made.extend(keys), [k * 2 for k in keys])[1], 4000)
    rng = random.Random(1)
    for _ in range(200):
        keys = list({rng.choice("abcdefgh") * rng.randrange(1, 9) for _ in range(10)}) + ["z" * rng.choice([1, 5000])]
        assert kept.of(keys) == [k * 2 for k in keys]
        assert sum(map(len, kept.known)) < 4000 and kept.held <= 4000
    assert 50 < len(made) < 2200


def test_long_texts(spark):
    """Texts of megabytes, with few and with no spaces."""
    long = ["word " * 400_000, "x" * 1_000_000, " ".join(f"w{k % 7000}" for k in range(300_000)), "a. b, " * 200_000, "\n".join(f"line {k} of a long text, with words." for k in range(40_000))]
    df = spark.createDataFrame(list(enumerate(long)), "doc_id bigint, text string")
    lib = Tokenizer.from_file(BYTE)
    got = {r.doc_id: np.frombuffer(r.ids_le, "<u4").tolist() for r in tokens.byte_bpe(df.filter("doc_id <> 1"), BYTE).collect()}
    assert all(got[d] == lib.encode(long[d], add_special_tokens=False).ids for d in got)
    path = common.scratch(spark, "ids")
    binary.write_ids(df, path, WORD, end_id=2)
    word = Tokenizer.from_file(WORD)
    ids = {r.doc_id: r.ids for r in binary.read_ids(spark, path).collect()}
    assert all(ids[d] == [*word.encode(long[d], add_special_tokens=False).ids, 2] for d in (0, 2, 3))
    judged = {r.doc_id: r.n_words for r in quality.line_first_rules(df).select("doc_id", "n_words").collect()}
    assert judged == {d: len(t.split()) for d, t in enumerate(long)}
    assert {r.doc_id: r.component_id for r in neardup.near_duplicates(df).collect()} == {d: d for d in range(5)}
    assert licenses.license_scan(df).filter("license is not null").count() == 0
    page = "<article>" + "".join(f"<p>Paragraph {k}</p><nav>Menu</nav>" for k in range(60_000)) + "</article>"
    (row,) = html.extract(spark.createDataFrame([(1, "http://x.example.com/", page)], "page_id bigint, url string, html string")).collect()
    assert row.text == "\n".join(f"Paragraph {k}" for k in range(60_000))


def brute_groups(pairs_of):
    sets, cls = {}, {}
    for d, text in pairs_of:
        w = (text or "").encode().lower().split()
        sets[d] = frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])
    ids = sorted(sets)
    links = [(a, b) for a in ids for b in ids if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    cls = components.forest(iter(links))
    return {d: (len(sets[d]), cls.get(d, d)) for d in ids}


def test_near_copies_is_brute_force(docs, none):
    want = brute_groups([(r.doc_id, r.text) for r in docs.select("doc_id", "text").distinct().collect() if r.doc_id is not None])
    got = neardup.near_duplicates(docs).collect()
    assert len(got) == docs.count()
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.n_shingles, r.component_id) == want[r.doc_id] and r.kept == (r.doc_id == r.component_id)
    assert neardup.near_duplicates(none).count() == 0


def test_near_copies_far_from_the_first(spark):
    """Families whose copies lie around the threshold from each other."""
    rng = random.Random(8)
    rows = []
    for family in range(4):
        base = words(rng, 150 + 60 * family)
        rows += [(len(rows) + k, " ".join(edited(rng, base, rng.randrange(1, 6)))) for k in range(45)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    want = brute_groups(rows)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(df).collect()}
    assert got == want and len({c for _, c in want.values()}) < len(rows)


def test_near_copies_just_under_the_threshold(spark, monkeypatch):
    """Families whose members are nearly all too far from each other: the pairs tested grow about as the members do, and no link is lost."""
    tested, verified = [], neardup._verified

    def counting(pairs, sets):
        tested.append(pairs.count())
        return verified(pairs, sets)

    monkeypatch.setattr(neardup, "_verified", counting)
    a_member = []
    for n in (150, 600):
        rng = random.Random(n)
        base = words(rng, 300)
        rows = [(k, " ".join(edited(rng, base, 4))) for k in range(n)] + [(n + k, " ".join(edited(rng, base, 1 + k % 3))) for k in range(n // 30)]
        tested.clear()
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
        assert got == brute_groups(rows)
        a_member.append(sum(tested) / len(rows))
    assert a_member[1] < 30 and a_member[1] < 3 * a_member[0] + 5


def brute_passages(rows):
    held, every, cut = defaultdict(list), defaultdict(set), defaultdict(set)
    for d, text in rows:
        w = (text or "").encode().split()
        for i in range(len(w) - 49):
            held[tuple(w[i : i + 50])].append((d, i))
    for places in held.values():
        first = min(d for d, _ in places)
        if any(d != first for d, _ in places):
            for d, i in places:
                every[d].update(range(i, i + 50))
                if d != first:
                    cut[d].update(range(i, i + 50))
    return {d: (every[d], cut[d]) for d in every}


@pytest.mark.parametrize("hot_rows", [repeats.HOT_ROWS, 3])
def test_passages_is_brute_force(docs, none, hot_rows):
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").distinct().collect() if r.doc_id is not None]
    want = brute_passages(rows)
    got = {r.doc_id: r for r in repeats.repeated_passages(docs, hot_rows=hot_rows).collect()}
    assert set(got) == set(want)
    for d, (every, cut) in want.items():
        assert {k for a, b in got[d].spans for k in range(a, b)} == every and got[d].n_repeated == len(every)
        assert {k for a, b in got[d].removed for k in range(a, b)} == cut and got[d].n_removed == len(cut)
    assert repeats.repeated_passages(none).count() == 0


def test_cut(docs):
    assert repeats.cut_words(b"  a b\nc  d ", [(1, 3)]) == b"  a d "
    assert repeats.cut_words(b"a b c", [(0, 3)]).split() == []
    left = repeats.without_passages(docs, repeats.repeated_passages(docs))
    assert left.schema == docs.schema
    assert repeats.repeated_passages(left.filter("doc_id >= 72 and doc_id < 97")).count() == 0


def test_mixing_is_sql(docs, none):
    once = docs.dropDuplicates(["doc_id"])
    got = rows_of(mixing.water_filling(once), "doc_id", "size", "source_size", "target", "taken")
    assert got == sorted(duck(once).execute(sql.op9_mixing).fetchall(), key=str)
    assert got == rows_of(mixing.water_filling(once.repartition(7)), "doc_id", "size", "source_size", "target", "taken")
    for _, size, _, _, taken in got:
        assert 0 <= taken <= 3 * size
    for source, part in once.groupBy("source").agg(F.count("*")).collect():
        rows = mixing.water_filling(once).filter(F.col("source").eqNullSafe(source)).collect()
        assert abs(sum(r.taken for r in rows) - rows[0].target) <= max(r.size for r in rows)
    assert mixing.water_filling(none).count() == 0


def test_mixing_of_equal_keys(spark):
    """Rows of one key or none, alike or not: each source meets its target within a document, as in SQL."""
    kind = "doc_id bigint, text string, source string, extra int"
    for keys in ([7] * 100, [None] * 100, [7] * 60 + [None] * 40, list(range(50)) + [3] * 50):
        rows = [(k, "ten words of text " * 2 + "and more", "a", 1) for k in keys] + [(1000 + i, "five words are in here", "b", 1) for i in range(300)] + [(2000 + i, f"six words in this one {i}", None, 1) for i in range(40)]
        df = spark.createDataFrame(rows, kind)
        got = rows_of(mixing.water_filling(df), "doc_id", "size", "source_size", "target", "taken")
        assert got == sorted(duck(df).execute(sql.op9_mixing).fetchall(), key=str)
        assert got == rows_of(mixing.water_filling(df.repartition(5)), "doc_id", "size", "source_size", "target", "taken")
        for source in ("a", "b", None):
            part = mixing.water_filling(df).filter(F.col("source").eqNullSafe(source)).collect()
            assert abs(sum(r.taken for r in part) - part[0].target) <= 10 and all(r.extra == 1 for r in part)


def test_components(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 499), (7, 7)], "u bigint, v bigint").repartition(9)
    got = {r.node: r.component for r in components.connected_components(chain).collect()}
    assert got == {**{i: 0 for i in range(201)}, 499: 499, 500: 499}


def test_few_links_need_no_rounds(spark, monkeypatch):
    """A small link table is settled at once, with what the rounds find."""
    rng = random.Random(5)
    frame = spark.createDataFrame([(rng.randrange(300), rng.randrange(300)) for _ in range(250)] + [(7, 7), (None, 3)], "u bigint, v bigint").repartition(5)
    writes = []
    monkeypatch.setattr(components, "stored", lambda df, name, real=components.stored: writes.append(name) or real(df, name))
    at_once = components.connected_components(frame).collect()
    assert writes == ["links"]
    monkeypatch.setattr(components, "FEW_LINKS", 0)
    in_rounds = components.connected_components(frame).collect()
    assert len(writes) > 3 and sorted(at_once) == sorted(in_rounds) and len({r.node for r in at_once}) == len(at_once)
    assert components.connected_components(frame.filter("u is null")).count() == 0
    monkeypatch.setattr(components, "FEW_LINKS", 10)
    assert components.connected_components(frame.filter("u is null")).count() == 0


def test_kept_keys_outlive_lone_ones():
    """A key that comes again and again is made once, however many others come between."""
    made = []
    kept = common.Kept(lambda keys: (made.extend(keys), [k * 2 for k in keys])[1], 40_000)
    for n in range(200):
        lone = [f"{n}-{i}" for i in range(20)]
        assert kept.of(lone) == [k * 2 for k in lone]
        if n % 3 == 0:
            assert kept.of(["often", lone[0]]) == ["oftenoften", lone[0] * 2]
        assert Counter(kept._bytes(x.keys(), x.values()) <= 20_000 for x in (kept.known, kept.older)) == {True: 2}
    assert made.count("often") == 1 and len(made) == 4001
