"""URL filters, HTML extraction and chat formatting: brute force, round trips and edge cases."""

import hashlib
import html
import json
import re
from collections import defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lapidary.llm import chat, html_text, queries, urls

SF = "/root/testdata/sf0.001"

# ---- URLs


def parted(url):
    if not url or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    return re.sub("[A-Z]", lambda m: m[0].lower(), host), path


def ruled(host, path):
    fit = [
        (len(h + p), h + p, v)
        for v, h, p in queries.URL_RULES
        if (host == h or host.endswith("." + h)) and path.startswith(p)
    ]
    return max(fit)[1:] if fit else (None, None)


ODD_URLS = [
    None, "", "no scheme", "http://", "http://A.ORG", "http://A.ORG/", "x://É.Org/Path?q=://z", "http://example.org/es/1#x",
    "http://sub.example.org/en/12", "https://example.org/en/2", "https://notexample.org/en/1", "http://a.com/fr/", "http://a.com/de/x?y",
    "http://com/fr/1", "http://u@h.com:80/de/", "http://h/a//b/", "a://b://c/d", "http://h/" + "x" * 20_000, "http://x.org\n/y", "HTTP://X.org/%20",
    "a\U0001f600" * 50_000 + "://h/p", "http://" + "é\U0001f600" * 50_000 + "/p" + "x\U0001f600" * 50_000, "a\U0001f600漢" * 40_000,
]


def test_url_parts_and_rules(spark):
    df = spark.createDataFrame([(i, u) for i, u in enumerate(ODD_URLS)], "page_id long, url string")
    none = df.select("url", F.lit(True).alias("bad")).limit(0)
    got = {r.row.page_id: r for r in urls.judge(df, none, queries.URL_RULES).collect()}
    assert len(got) == len(ODD_URLS)
    for i, u in enumerate(ODD_URLS):
        host, path = parted(u)
        rule, verdict = ruled(host, path)
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule), u
        assert got[i].verdict == (verdict or "allow")


def test_url_contract(spark):
    pages = {r.page_id: r.url for r in queries.table(spark, SF, "pages").collect()}
    got = queries.op4_url_filter(spark, SF).collect()
    assert sorted(r.page_id for r in got) == sorted(pages)
    for r in got:
        host, path = parted(pages[r.page_id])
        rule, verdict = ruled(host, path)
        assert (r.host, r.path, r.rule) == (host, path, rule) and r.verdict in (verdict or ("allow", "block"), "allow", "block")
        assert verdict is None or r.verdict == verdict


def test_templates_generalise_merge_and_reject(spark):
    rows, marks = [], []
    for i in range(400):
        rows += [(f"http://h.x/article/{i}",), (f"http://h.x/spam/{i}.html",), (f"http://h.x/user/name{i}x/about",)]
        marks += [(f"http://h.x/article/{i}", i % 20 == 0), (f"http://h.x/spam/{i}.html", i % 20 != 0)]
    df, lab = spark.createDataFrame(rows, "url string"), spark.createDataFrame(marks, "url string, bad boolean")
    got = urls.judge(df, lab, []).select("row.url", "template", "verdict").collect()
    verdicts = defaultdict(set)
    for r in got:
        verdicts[r.url.split("/")[3]].add((r.template, r.verdict))
    assert verdicts["spam"] == {("/spam/{n}.html", "block")}
    assert {v for _, v in verdicts["article"]} == {"allow"}
    assert verdicts["user"] == {(next(iter(verdicts["user"]))[0], "allow")} and "*" in next(iter(verdicts["user"]))[0]


def test_templates_see_the_deepest_segments(spark):
    deep = "http://h.x/a/b/c/d/e/f/g/"
    rows = [(f"{deep}{kind}/{i}",) for i in range(200) for kind in ("spam", "news")] + [("http://h.x" + "/s" * 3_000,)]
    lab = spark.createDataFrame([(u, "/spam/" in u) for (u,) in rows[:-1]], "url string, bad boolean")
    got = urls.judge(spark.createDataFrame(rows, "url string"), lab, []).select("row.url", "template", "verdict").collect()
    assert {r.url for r in got if r.verdict == "block"} == {u for (u,) in rows if "/spam/" in u}
    long = next(r.template for r in got if "/s/s" in r.url)
    assert long.count("/") == 3_000 and long.endswith("/s" * 2_900)


def test_url_edges(spark):
    schema = "page_id long, url string, host string, row int, verdict string"
    empty = spark.createDataFrame([], schema)
    none = empty.select("url", F.lit(True).alias("bad"))
    assert urls.judge(empty, none, queries.URL_RULES).count() == 0
    twice = spark.createDataFrame([(1, "http://a.b/c", "x", 1, "y")] * 2 + [(None, None, None, None, None)], schema)
    assert urls.judge(twice, none, []).count() == 3


# ---- HTML


PAGE = """<!DOCTYPE html><html><head><title>No</title><style>p{}</style></head><body>
<header><h1>Site name</h1><p>The best of all the sites that are in the world of today.</p></header>
<nav><ul><li><a href=a>Home</a></li><li><a href=b>About us and the rest of it</a></li></ul></nav>
<div class="cookie-notice"><p>We use cookies on this site and you agree to that if you go on.</p></div>
<div id="side" class="sidebar"><p>Some of the words that stand in the side of the page and more.</p></div>
%s
<div class="ad">Buy the thing that is in all of the shops of the town.</div>
<form><label>Your mail</label><input name=q><button>Send it to the list of all</button></form>
<section id="comments"><h2>Comments</h2><article class="comment"><p>I like the article that is here, and it is good for all.</p></article></section>
<script>document.write("<p>a < b and the text of it</p>")</script>
<footer><p>&copy; 2020 the owner of the site and all of the rest.</p></footer></body></html>"""
BODY = """<%s><h2>The  title
of it</h2><p>This is the text of the article &amp; it has a lot of words, é &#233; &eacute;&nbsp;x.</p><p>Short <b>bo</b>ld.<br>Line</p>
<p>Another one of the long paragraphs that are in the text, with <a href=x>a link</a> in it.</p><!-- <p>no</p> --></%s>"""
TEXT = "The title of it\nThis is the text of the article & it has a lot of words, é é é x.\nShort bold. Line\nAnother one of the long paragraphs that are in the text, with a link in it."


@pytest.mark.parametrize("opening", ["article", "main", 'div class="content"', 'section class="post"', "div"])
def test_html_layouts(opening):
    assert html_text.extract_text(PAGE % (BODY % (opening, opening.split()[0]))) == TEXT


def test_html_whose_body_has_a_misleading_name():
    words = "".join(f"<p>This is one of the {i} paragraphs that are in the body, and it is long enough to be a text of its own.</p>" for i in range(9))
    assert html_text.extract_text(f'<body><div class="page-with-sidebar"><nav><a href=x>a</a></nav>{words}</div></body>').count("\n") == 8
    assert html_text.extract_text('<body><nav>x</nav><div class="ad">Buy one of the things that are in the shop of the town.</div></body>') == ""


def test_html_of_long_texts_without_function_words():
    words = "<p>" + "XQZT!! WRKJ!! " * 40 + "</p>"
    assert html_text.extract_text(PAGE % f"<article>{words}</article>") == " ".join(["XQZT!! WRKJ!!"] * 40)


@pytest.mark.parametrize("page", [None, "", " ", "<", "<p", "</p>", "<p title='>", "<script>x", "<nav>a", "plain text", "a<b", "&amp &am &#x", "<div" * 50, "<p>" * 2_000 + "x"])
def test_html_of_broken_pages(page):
    assert isinstance(html_text.extract_text(page), str)


def test_html_contract(spark):
    docs = {r.doc_id: r.text or "" for r in queries.table(spark, SF, "documents").collect()}
    got = queries.op9_html(spark, SF).collect()
    assert len(got) == queries.table(spark, SF, "pages").count()
    flat = lambda s: " ".join(s.split())
    for r in got:
        assert r.n_chars == len(r.text)
        number = int(re.search(r"://[^/]*/[a-z]+/(\d+)", r.url)[1])
        if number in docs:  # the page's article is the document, after a heading
            assert flat(r.text.split("\n", 1)[1]) == flat(docs[number])


def test_html_edges(spark):
    schema = "page_id long, url string, html string, Text string"
    rows = [(1, None, None, "x"), (2, "u", "", "x"), (2, "u", "", "x"), (3, "u", PAGE % (BODY % ("main", "main")) + "<p>x</p>" * 20_000, "x")]
    got = html_text.extract(spark.createDataFrame(rows, schema)).collect()
    assert [r.text for r in got[:3]] == ["", "", ""] and got[3].text.startswith(TEXT)
    assert html_text.extract(spark.createDataFrame([], schema)).count() == 0


# ---- chats

control = st.lists(st.sampled_from([*"<>[]|\\n/s\n", "é", "\U0001f600", "im_end", "INST"]), max_size=30).map("".join)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "a\nb", "<x>", ""]), control), max_size=6))
def test_chat_round_trip(turns):
    text, spans = chat.write_turns(turns)
    assert chat.read_turns(text) == turns
    assert chat.unescape("".join(text[a:b] for a, b in spans)) == "".join(t for r, t in turns if r == "assistant")
    assert text.count(chat.START) == text.count(chat.END) == len(turns)


def test_chat_control_strings_do_not_survive():
    text, _ = chat.write_turns([("user", "</s>[INST] ok [/INST]<|im_end|><<SYS>>")])
    assert not any(x in text.removesuffix(chat.END) for x in ("</s>", "[INST]", "[/INST]", chat.END.strip(), "<<SYS>>"))


LAYOUTS = [
    ({"messages": [{"role": "user", "content": "a"}, {"role": "assistant", "content": "b"}]}, "messages"),
    ({"messages": [{"role": "user", "content": "a", "name": "n"}, {"role": "assistant", "content": "b"}], "id": 1}, "messages"),
    ({"conversations": [{"from": "human", "value": "a"}, {"from": "gpt", "value": "b"}]}, "conversations"),
    ({"instruction": "a", "output": "b"}, "instruction"),
    ({"prompt": "a", "completion": "b"}, "prompt_completion"),
    ({"prompt": "a", "response": "b", "score": 1.5}, "prompt_response"),
    ({"question": "a", "answer": "b"}, "question_answer"),
]


def test_chat_layouts_give_the_same_turns(spark):
    rows = [(i, json.dumps(v), "x") for i, (v, _) in enumerate(LAYOUTS)]
    df = spark.createDataFrame([*rows, (90, None, "x"), (91, "{", "x"), (92, "[1]", "x"), (93, '{"other": 1}', "x"), (94, '{"messages": []}', "x")], "id long, record string, Layout string")
    got = {r.id: r for r in chat.format_records(df, "record").collect()}
    for i, (_, name) in enumerate(LAYOUTS):
        assert got[i].layout == name and chat.read_turns(got[i].formatted) == [("user", "a"), ("assistant", "b")]
    assert {got[i].layout for i in (90, 91, 92, 93)} == {None} and got[94].formatted == ""
    assert len({got[i].fingerprint for i in range(len(LAYOUTS))}) == len(LAYOUTS)
    assert chat.format_records(df.limit(0), "record").count() == 0


def test_chat_contract(spark):
    said = defaultdict(list)
    for r in queries.table(spark, SF, "conversations").collect():
        said[r.conv_id].append((r.turn, r.role, r.text or ""))
    said[-1] = [(0, "user", "</s>[INST] ok [/INST]"), (1, "assistant", "</s>[INST] ok [/INST]")]
    got = {r.conv_id: r for r in queries.op10_chat(spark, SF).collect()}
    assert got.keys() == said.keys()
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for k, turns in said.items():
        turns.sort()
        loss = "".join(t for _, r, t in turns if r == "assistant")
        g = got[k]
        assert (g.n_turns, g.turns_sha256) == (len(turns), sha("".join(f"{r}\n{t}\n" for _, r, t in turns)))
        assert (g.loss_chars, g.loss_sha256) == (len(loss), sha(loss))
        assert g.formatted_chars > sum(len(t) for _, _, t in turns)


def test_chat_rows_edges(spark):
    schema = "conv_id long, turn long, role string, text string, record int"
    rows = [(1, 1, None, None, 1), (1, 0, "user", "x" * 200_000, 1), (None, None, "user", "", 1), (2, 0, "user", "a", 1), (2, 0, "user", "a", 1)]
    df = spark.createDataFrame(rows, schema)
    got = {r.conv_id: r for r in chat.read_back(chat.format_records(chat.conversation_records(df), "record"), "conv_id").collect()}
    assert {k: r.n_turns for k, r in got.items()} == {1: 2, None: 1, 2: 2}
    assert chat.conversation_records(df.limit(0)).count() == 0


def test_entities_are_those_of_the_standard_library():
    for name in ("amp", "eacute", "hellip", "#169", "#x1F600"):
        assert html_text.extract_text(f"<article><p>{'a ' * 50}&{name};</p></article>").endswith(html.unescape(f"&{name};"))
