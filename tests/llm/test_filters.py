"""Quality rules, line spread, HTML text, URL filter, licences, toxicity."""

import html
import re
import textwrap
from collections import Counter, defaultdict

import pyarrow as pa
import pytest
from cases import WORD, awkward, documents, prose
from conftest import DATA
from ledgerwatch.llm import boilerplate, grammar, html_text, licenses, quality, toxicity, url_filter
from ledgerwatch.llm.frames import table
from pyspark.sql import functions as F


def plain_measures(text):
    text = text or ""
    words = WORD.findall(text)
    windows = Counter(zip(words, words[1:], words[2:], strict=False))
    covered = set()
    for i in range(len(words) - 2):
        if windows[tuple(words[i : i + 3])] > 1:
            covered |= {i, i + 1, i + 2}
    seen, again = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            again += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), again, len(covered)


@pytest.mark.parametrize("source", [documents, awkward])
def test_quality_measures_equal_plain_code(spark, source):
    docs = source(spark)
    got = quality.repetition_report(docs).collect()
    want = Counter((r.doc_id, *plain_measures(r.text)) for r in docs.collect())
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == want
    for r in got:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) and not (r.base_failed and r.kept)


def test_quality_keeps_clean_and_all_columns(spark):
    docs = awkward(spark)
    kept = quality.keep_good(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["4", "4", "4", "5", "9", "None"]
    assert quality.keep_good(docs.limit(0)).count() == 0 and quality.repetition_report(docs.limit(0)).count() == 0
    junk = " ".join(f"{w}###" for w in prose(5, 100).split())
    loops = "\n".join([prose(6, 20)] * 2 + [prose(7, 160)])
    assert quality.judge(quality.measure(pa.array([junk, prose(8, 200), loops])))[1].tolist() == [False, True, True]


def test_quality_agrees_with_labels(spark):
    got = quality.repetition_report(table(spark, DATA, "documents")).join(table(spark, DATA, "labels"), "doc_id").where("not base_failed")
    assert got.where("kept <> (quality = 1)").count() == 0


def test_line_spread_equals_plain_code(spark):
    docs = documents(spark)
    rows = docs.collect()
    sites, texts = defaultdict(set), defaultdict(set)
    for r in rows:
        for line in r.text.split("\n"):
            if line.strip(" \t\n\r\x0b\x0c"):
                sites[line.strip(" \t\n\r\x0b\x0c")].add(r.source)
                texts[line.strip(" \t\n\r\x0b\x0c")].add(r.text)
    bad = {x for x in sites if len(sites[x]) >= 5 and len(texts[x]) >= 5}
    assert bad
    # near copies among the texts that hold such lines count as one
    holders = sorted(set().union(*(texts[x] for x in bad)))
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (t.lower().split() for t in holders)]
    copy = list(range(len(holders)))
    for i in range(len(holders)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if common >= 0.8 * (len(sets[i]) + len(sets[j]) - common) and copy[i] != copy[j]:
                copy = [copy[j] if c == copy[i] else c for c in copy]
    copy_of = dict(zip(holders, copy, strict=True))
    bad = {x for x in bad if len({copy_of[t] for t in texts[x]}) >= 5}
    assert bad
    want = {r.doc_id: "\n".join(x for x in r.text.split("\n") if x.strip(" \t\n\r\x0b\x0c") not in bad) for r in rows}
    got = boilerplate.remove_boilerplate(docs, min_sites=5, removed="gone").collect()
    assert {r.doc_id: r.text for r in got} == want and len(got) == len(rows)
    assert sum(r.gone for r in got) > 0


def test_line_spread_far_above_threshold_and_awkward_rows(spark):
    line = "All of this was printed at the foot of every page of the paper"
    rows = [(i, prose(i, 60) + f"\n {line} \n" + prose(i + 500, 50), "en", f"site{i}", 1) for i in range(60)]
    rows += [(100 + i, prose(999, 60), "en", f"site{i}", 1) for i in range(30)]  # equal copies spread nothing
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    got = {r.doc_id: r.text for r in boilerplate.remove_boilerplate(docs).collect()}
    assert all(line not in got[i] and len(got[i].split("\n")) == 2 for i in range(60)) and got[100] == prose(999, 60)
    odd = awkward(spark)
    cleaned = boilerplate.remove_boilerplate(odd)
    assert cleaned.columns == odd.columns and cleaned.count() == odd.count() and cleaned.where("text is null").count() == 2
    assert boilerplate.remove_boilerplate(odd.limit(0)).count() == 0


def test_long_passages_go_on_few_sites(spark):
    hot, three, rare, short = prose(701, 55), prose(702, 50), prose(703, 60), prose(704, 12)
    rows = [(i, f"{prose(i, 60)}\n {hot}\n{short}\n{prose(i + 500, 50)}", "hot") for i in range(40)]
    rows += [(100 + i, f"{prose(i + 100, 60)}\n{three}\n{prose(i + 600, 50)}", f"s{i % 3}") for i in range(10)]  # exactly at the threshold
    rows += [(200 + i, f"{prose(i + 200, 60)}\n{rare}\n{prose(i + 700, 50)}", "hot") for i in range(9)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    got = {r.doc_id: r.text for r in boilerplate.remove_boilerplate(docs).collect()}
    assert all(got[i].split("\n") == [prose(i, 60), short, prose(i + 500, 50)] for i in range(40))
    assert all(got[100 + i].split("\n") == [prose(i + 100, 60), prose(i + 600, 50)] for i in range(10))
    assert all(rare in got[200 + i] for i in range(9))


def test_mixes_of_shared_lines_lose_them_and_near_copies_do_not(spark):
    shared = [prose(300 + i, 14) for i in range(8)]
    pages = [(i, f"{prose(i, 40)}\n{shared[i % 8]}\n{shared[(i + 3) % 8]}\n{prose(i + 900, 40)}", f"s{i % 20}") for i in range(160)]
    mixes = [(1000 + i, "\n".join(shared[(i + j * (1 + i % 3)) % 8] for j in range(5)), f"s{i % 20}") for i in range(24)]
    words = [prose(350 + i, 25).split() for i in range(12)]
    copies = []
    for i in range(60):  # one word of one line differs
        own = [list(x) for x in words]
        own[i % 12][i // 12 * 4] = f"w{i}"
        copies.append((2000 + i, "\n".join(map(" ".join, own)), f"s{i % 20}"))
    # 20 near copies of an article of which 7 of 10 lines are the same everywhere
    long_lines, family = [prose(370 + i, 30).split() for i in range(10)], []
    for i in range(20):
        own = [list(x) for x in long_lines]
        for line in (0, 4, 9):
            own[line][i] = f"v{i}"
        family.append((3000 + i, "\n".join(map(" ".join, own)), f"s{i}"))
    docs = spark.createDataFrame(pages + mixes + copies + family, "doc_id bigint, text string, source string")
    got = {r.doc_id: (r.text, r.gone) for r in boilerplate.remove_boilerplate(docs, removed="gone").collect()}
    assert all(got[i] == (f"{prose(i, 40)}\n{prose(i + 900, 40)}", 2) for i, *_ in pages)
    assert all(got[i][0] == "" for i, *_ in mixes) and all(got[i] == (text, 0) for i, text, _ in copies + family)


def test_copy_keys_equal_plain_classes(spark):
    """Near copies that differ at the front, and a chain of twelve texts, each near the next five."""
    texts = sorted({r.text for r in documents(spark).collect() if r.text})
    base, ahead = prose(400, 120), prose(401, 60).split()
    texts += [" ".join([*ahead[:i], base]) for i in range(8)]
    stream = prose(402, 300).split()
    texts += [" ".join(stream[3 * i : 3 * i + 150]) for i in range(12)] + ["", " \n ", "one", "ONE", "one two"]
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (t.lower().split() for t in texts)]
    copy = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if common >= 0.8 * (len(sets[i]) + len(sets[j]) - common) and copy[i] != copy[j]:
                copy = [copy[j] if c == copy[i] else c for c in copy]
    want = {frozenset(k for k, c in enumerate(copy) if c == x) for x in set(copy)}
    hashed = spark.createDataFrame([(t,) for t in texts], "text string").selectExpr("xxhash64(text) AS body", "text")
    body = {r.text: r.body for r in hashed.collect()}
    keys = {r.body: r.copy for r in boilerplate.copy_keys(hashed).collect()}
    groups = defaultdict(set)
    for k, t in enumerate(texts):
        groups[keys.get(body[t], body[t])].add(k)
    assert set(map(frozenset, groups.values())) == want and max(map(len, want)) >= 12


def test_line_spread_is_linear_in_a_text(spark):
    shared = [prose(450 + i, 6) for i in range(40)]
    rows = [(i, "\n".join([prose(i, 40), *shared]), f"s{i}") for i in range(12)]
    rows.append((99, "\n".join(shared[i % 40] if i % 2 else f" own {i} " for i in range(60000)), "s99"))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    got = {r.doc_id: (r.text, r.gone) for r in boilerplate.remove_boilerplate(docs, removed="gone").collect()}
    assert got[99] == ("\n".join(f" own {i} " for i in range(0, 60000, 2)), 30000)
    assert all(got[i] == (prose(i, 40), 40) for i in range(12))


def test_line_spread_has_no_python(spark, capsys):
    boilerplate.remove_boilerplate(documents(spark)).explain()
    assert not re.search("Python|Arrow", capsys.readouterr().out)


def plain_article(page):
    body = re.search(r"<article>(.*?)(</article>|\Z)", page or "", re.S).group(1)
    blocks = re.split(r"</?(?:p|h1|article)>", body)
    blocks = [" ".join(html.unescape(re.sub("<br>", " ", re.sub("</?b>", "", b))).split()) for b in blocks]
    return "\n".join(b for b in blocks if b)


def test_html_text_of_all_pages(spark):
    got = html_text.extract_pages(table(spark, DATA, "pages")).collect()
    want = {r.page_id: plain_article(r.html) for r in table(spark, DATA, "pages").collect()}
    assert {r.page_id: r.text for r in got} == want and all(r.n_chars == len(r.text) for r in got)


def test_html_text_without_marked_article(spark):
    page = """<title>t</title><body><header><h1>Site</h1></header><div class="cookie-notice"><p>We use cookies<p>and more</div>
    <div id=menu><ul><li><a href=a>A</a><li><a>B</a><li><a>C</a></ul></div><div id="content"><h1>Title</h1><p>A long   text with &lt;tags&gt; &amp; more words, so
    that it surges well above eighty characters.<p>Short.<div class="ad">Buy!</div><p>Second<br>line.</p><form><input>Name</form><p>The end.</div>
    <div class="comments"><p>a reader's comment that is long enough to be a surge of its own, and another sentence on top</p></div><aside>side</aside><footer>foot</footer>"""
    assert html_text.main_text(page).split("\n") == [
        "Title", "A long text with <tags> & more words, so that it surges well above eighty characters.", "Short.", "Second line.", "The end.",
    ]
    assert [html_text.main_text(x) for x in (None, "", "<p>", "x &lt; y", "<script>a</script>", "<nav>a</nav>b")] == ["", "", "", "x < y", "", "b"]
    assert html_text.main_text("<form><nav>n</nav><article><p>x</article><article class=comment>y</article></form>") == "x"
    odd = spark.createDataFrame([(None, None, None, "z"), (1, "u", "", "z"), (1, "u", "", "z"), (2, "v", "<p>" + "w " * 100_000, "z")], "page_id int, url string, html string, text string")
    assert sorted(r.n_chars for r in html_text.extract_pages(odd).collect()) == [0, 0, 0, 199_999]
    assert html_text.extract_pages(odd.limit(0)).count() == 0


def test_html_text_after_skipped_blocks_without_end_tags():
    long = "A long text with many words, so that it surges well above eighty characters in any case."
    assert html_text.main_text(f'<body><div id=page><p class="notice">Cookies<p>{long}<p>Second.</div>') == f"{long}\nSecond."
    assert html_text.main_text(f"<ul><li class=share>Share<li>{long}<li>Second.</ul>") == f"{long}\nSecond."
    assert html_text.main_text(f"<div><p class=notice>Cookies</div>{long}") == long
    assert html_text.main_text(f"<dl><dt>T<dd class=ad>Buy<dt>{long}</dl>") == f"T\n{long}"
    assert html_text.main_text(f"<table><tr><td class=menu>M<p>N<td>{long}<tr><td class=ad>Buy</table>") == long
    assert html_text.main_text(f"<div><div class=ad><ul><li>a<ul><li>b</ul><li>c</ul><p>d</div><p>{long}</div>") == long
    assert html_text.main_text(f"<nav><script>'</nav></div>'</script>x</nav><p>{long}") == long


@pytest.mark.parametrize("marked", [True, False])
def test_html_text_after_raw_text_and_odd_tags(marked):
    long = "A sentence of the article that is long enough to be told from the rest. " * 3
    long = long.strip()
    article = f"<article><p>{long}</article>" if marked else f"<div><p>{long}</div>"
    scripts = [
        "<script>for(var i=0;i<n;i++){x()}</script>", '<script>var s="<!--";</script>', "<script>if (a<b) document.write('<p>no</p><\\/script>')</script>",
        "<style>a:before{content:'<'}</style>", "<textarea><p>no</textarea>", "<SCRIPT>x</Script >", "<nav><script>'</nav>' < \"<!--\"</script>no</nav>",
        "<p title=it's></p>", "<p title='>' class=x></p>", "<p don't></p>", "<svg><path d='M0<1'/></svg>", "<![CDATA[ ]]>",
    ]
    for x in scripts:
        assert html_text.main_text(f"<html><body>{x}{article}</body>") == long, x
        assert html_text.main_text(f"<html><body>{article}{x}</body>") == long, x
    assert html_text.main_text(f"<body>{article}<p class=ad") == long and html_text.main_text(f"<body>{article}<script>if (a<b)") == long


def test_html_text_of_hostile_pages_is_linear():
    """A megabyte each; a scan that starts anew at every tag would take minutes."""
    import time

    for piece in ("<a ", "<ul>", "<ul><li>a", '<a x="', "<a x='", "<![CDATA[", "<!--", "<div>a", "<p>", "&", "<script>", "<b a=b", "</div>", "<td><p>x", "<h1>a<h2>"):
        page = piece * (1_000_000 // len(piece))
        began = time.process_time()
        html_text.main_text(page)
        assert time.process_time() - began < 8, piece


def test_html_text_keeps_short_blocks_beside_the_article():
    long = "A long text with many words, so that it surges well above eighty characters in any case."
    form, menu = "<form><p>Name<p>Mail<p>Send</form>", "<ul class=menu><li>A<li>B<li>C</ul>"
    page = f"<body><div class=top><p>Site</div>{menu}<div id=content><h1>Title</h1>{menu}<p>{long}</p>{form}<p>The end.</p></div>{menu}<div><p>Imprint</div>"
    assert html_text.main_text(page) == f"Title\n{long}\nThe end."
    assert html_text.main_text(f"<div><div>Title</div>{menu}<div>{long}</div>{form}<div>The end.</div></div>") == f"Title\n{long}\nThe end."
    assert html_text.main_text(f"<div><h1>Title</h1>{menu}<p>Short.{form}<p>The end.</div>") == "Title\nShort.\nThe end."


def test_line_block_regions():
    assert html_text.regions([0, 0, 5, 0, 0, 0, 90, 3, 0, 0, 40, 0, 0, 0], 80) == [(4, 11)]
    assert html_text.regions([], 80) == [] and html_text.regions([5], 80) == []


def plain_rule(url):
    if url is None or "://" not in url:
        return "", "", None
    rest = url[url.index("://") + 3 :]
    host = re.match(r"[^/?#]*", rest).group()
    path = re.match(r"[^?#]*", rest[len(host) :]).group()
    host = re.sub("[A-Z]", lambda c: c.group().lower(), host)
    fits = [r for r, _ in url_filter.RULES if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith("/" + r.split("/", 1)[1])]
    return host, path, max(fits, key=len, default=None)


def test_url_rules_and_trees(spark):
    odd = [(None, None), (9001, "no scheme"), (9002, "HTTP://ExAmple.ORG/ES/x?y#z"), (9003, "a://example.org"), (9004, "x://org?/"), (9004, "x://org?/"), (9005, "b://q/" + "1" * 20_000)]
    pages = table(spark, DATA, "pages").select("page_id", "url").union(spark.createDataFrame(odd, "page_id bigint, url string")).withColumn("host", F.lit(1)).withColumn("block", F.lit("q"))
    got = url_filter.judge_urls(pages).collect()
    assert Counter((r.page_id, r.host, r.path, r.rule) for r in got) == Counter((r.page_id, *plain_rule(r.url)) for r in pages.collect())
    kinds = dict(url_filter.RULES)
    assert all(r.verdict == kinds[r.rule] if r.rule else r.verdict in ("allow", "block") and r.score is not None for r in got)
    none = url_filter.judge_urls(pages, rules=[("net/", "allow")])
    assert none.where("verdict <> 'allow'").count() == 0 and url_filter.judge_urls(pages.limit(0)).count() == 0


def test_trees_learn_given_labels(spark):
    rows = [(i, f"http://{'spam' if i % 3 == 0 else 'news'}{i}.example.net/{'9' * 12 if i % 3 == 0 else 'story'}/{i}") for i in range(600)]
    pages = spark.createDataFrame(rows, "page_id int, url string")
    labels = pages.where("page_id < 400").select("url", (F.col("page_id") % 3 == 0).cast("int").alias("block"))
    got = url_filter.judge_urls(pages, rules=[], labels=labels).where("page_id >= 400")
    assert got.where((F.col("verdict") == "block") != (F.col("page_id") % 3 == 0)).count() == 0


def test_url_filter_has_no_python(spark, capsys):
    url_filter.judge_urls(table(spark, DATA, "pages")).explain()
    assert not re.search("Python|Arrow", capsys.readouterr().out)


NOTICES = {
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.", "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "MIT": "Released under the MIT License.", "Apache-2.0": "Licensed under the Apache License, Version 2.0.", "all-rights-reserved": "All rights reserved.",
}


def test_licences_of_all_documents(spark):
    got = {(r.doc_id, r.license) for r in licenses.scan_licenses(documents(spark)).collect()}
    assert got == {(r.doc_id, k) for r in documents(spark).collect() for k, v in NOTICES.items() if v in r.text}


def test_licence_wordings(spark):
    for name, wording in licenses.WORDINGS.items():
        found = licenses.scan(f"{prose(1, 30)}.\n\n{wording} {prose(2, 30)}")
        assert name in [f[2] for f in found] and not [f for f in found if f[2] == name][0][5]
    changed = licenses.scan("Licensed under the GNU General Public License, version 2.")
    assert [f[2] for f in changed] == ["GPL-2.0"]
    assert licenses.scan("The licence of the driver expired.") == [] and licenses.scan("") == []
    odd = licenses.scan_licenses(awkward(spark))
    assert odd.count() == 0 and licenses.scan_licenses(awkward(spark).limit(0)).count() == 0


def test_licences_in_wrapped_lines_and_lists():
    for width in (40, 60, 72):
        for name, wording in licenses.WORDINGS.items():
            for mark in ("", " * ", "# "):
                lines = textwrap.wrap(wording.replace("conditions: The", "conditions:\n\nThe"), width) if mark else [x for p in wording.replace("conditions: The", "conditions:\n\nThe").split("\n\n") for x in [*textwrap.wrap(p, width), ""]]
                text = f"{prose(1, 30)}.\n\n" + "\n".join(mark + x for x in lines) + f"\n\n{prose(2, 30)}"
                found = [f for f in licenses.scan(text) if f[2] == name]
                assert len(found) == 1 and not found[0][5] and not found[0][6], (name, width, mark)
    three = "Licensed under the MIT License, the Apache License, Version 2.0 and the GNU General Public License, version 3."
    two = "Released under the GNU General Public License, version 3 or the MIT License."
    assert {f[2] for f in licenses.scan(three)} == {"MIT", "Apache-2.0", "GPL-3.0"} and {f[2] for f in licenses.scan(two)} == {"MIT", "GPL-3.0"}
    for name, title in licenses.NAMES.items():
        assert [f[2] for f in licenses.scan(f"Distributed under the terms of the {title}.")] == [name]


def test_grammar_contexts():
    score = lambda *s: grammar.clause_score([(i, c, 2.0) for i, c in s])
    assert score((0, "I")) == 2.0 and score((0, "N"), (1, "I")) == pytest.approx(2.0 * grammar.NEGATED)
    assert score((0, "N"), (9, "I")) == 2.0 and score((0, "R"), (9, "I")) == pytest.approx(2.0 * grammar.REPORTED)
    assert score((0, "Y"), (2, "I")) == pytest.approx(2.0 * grammar.AIMED) and score((0, "Y"), (8, "I")) == 2.0
    assert score((0, "H")) == 0 and score((0, "H"), (1, "Y")) == pytest.approx(2.0 * grammar.THREAT) and score((0, "H"), (7, "Y")) == 0
    assert score((0, "N"), (1, "H"), (2, "Y")) == pytest.approx(2.0 * grammar.THREAT * grammar.NEGATED)
    assert score() == 0


def test_toxicity_learns_and_holds_out(spark):
    bad = ["grumpelan", "grumpelor", "grumpelix", "zorkent"]
    rows = [(i, prose(i, 60) + (f" {bad[i % 4]} {prose(i + 9, 5)} {bad[(i + 1) % 4]}" if i % 4 == 0 else ""), i % 4 == 0) for i in range(600)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, int(x)) for i, _, x in rows], "doc_id bigint, toxic int")
    got = {r.doc_id: r for r in toxicity.score_toxicity(docs, labels).collect()}
    held = [i for i in got if got[i].held_out]
    assert len(held) > 100 and all((got[i].predicted == 1) == (i % 4 == 0) for i in held)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got.values())


def test_toxicity_awkward_rows(spark):
    none = spark.createDataFrame([], "doc_id bigint, toxic int")
    some = spark.createDataFrame([(None, 1), (4, None), (4, 1), (5, 0), (5, 0)], "doc_id bigint, toxic int")
    for labels in (none, some):
        got = toxicity.score_toxicity(awkward(spark), labels)
        assert got.count() == awkward(spark).count() and got.where("score is null or score < 0 or score > 1").count() == 0
    assert toxicity.score_toxicity(awkward(spark).limit(0), none).count() == 0
    assert toxicity.score_toxicity(spark.createDataFrame([(1, "you idiot"), (2, "you friend")], "doc_id int, text string"), none).where("predicted = 1").count() == 1
