import hashlib
import itertools
import random
import time
import zlib

import duckdb
import pytest

from corpusloom.llm import html_extract, warc
from corpusloom.llm.common import run_folder

PAGES = "page_id LONG, url STRING, html STRING, text STRING, payload STRING, digest STRING, n INT"


def pages_of(spark, rows):
    return spark.createDataFrame([(*r, "a", "b", "c", 1) for r in rows], PAGES)


def cost(odds, edges, labels):
    ends = sum(max(o, 0) if not x else max(-o, 0) for o, x in zip(odds, labels, strict=True))
    return ends + sum(c for (i, j), c in edges.items() if labels[i] != labels[j])


@pytest.mark.parametrize("seed", range(8))
def test_cut_is_minimal(seed):
    rng = random.Random(seed)
    for _ in range(25):
        n = rng.randint(1, 8)
        odds = [rng.choice([rng.uniform(-3, 3), rng.randint(-2, 2)]) for _ in range(n)]
        edges = {(i, j): rng.uniform(0, 2) for i in range(n) for j in range(i + 1, n) if rng.random() < 0.5}
        best = min(cost(odds, edges, x) for x in itertools.product([False, True], repeat=n))
        assert cost(odds, edges, html_extract.minimum_cut(odds, edges)) == pytest.approx(best)


PAGE = """<!DOCTYPE html><html lang=en><head><title>T</title><style>p{}</style></head><body class="has-sidebar">
<header><a href="/">Home</a><p>The site of many things, a slogan.</p></header><nav><ul><li><a href=x>One</a></li></ul></nav>
<main><article><header><h1>A &lt;title&gt; &amp; more</h1></header><p>First&nbsp;para with <b>bold</b>, a <a href="y">link</a>
and &copy; signs.<p>Second <!-- no --> para<br>goes on.</p><ul><li>item one</li><li>item two</li></ul>
<table><tr><td>cell</td><td>cell two</td></tr></table><div class="ad">Buy this thing now, it is good.</div>
<aside>See this other story too, dear reader.</aside><form><p>Enter your name here, please.</p></form>
<section id="comments"><h3>Comments</h3><p>I did not like this long article, and I say so here at length.</p></section>
</article></main><div class="cookie-notice">We use cookies for all things. Accept them.</div><script>if (a<b) x("</p>");</script>
<footer>All rights kept, and some more words here.</footer></body></html>"""


def test_page_with_everything():
    assert html_extract.main_text(PAGE) == ("A <title> & more\nFirst para with bold, a link and © signs.\nSecond para goes on.\nitem one\nitem two\ncell cell two")


def test_page_without_semantic_elements():
    page = ('<div id=menu><a href=1>One</a> <a href=2>Two</a></div><div id="content"><h2>Head</h2><p>Some words of the story, told in full.</p>'
            '<p>Short.</p><p>More words of the story, told in full again.</p></div><div class="footer-links"><a href=3>Imprint</a></div>')
    assert html_extract.main_text(page) == "Head\nSome words of the story, told in full.\nShort.\nMore words of the story, told in full again."


def test_formulas_and_fallbacks_stay():
    page = ("<article><p>Let <math><mi>x</mi><mo>+</mo><mi>y</mi><annotation>x+y</annotation></math> be given, and so on it goes.</p>"
            "<object data=z>What is shown in place of the picture, in words.</object></article>")
    assert html_extract.main_text(page) == "Let x+y be given, and so on it goes.\nWhat is shown in place of the picture, in words."


def test_a_list_of_links_within_prose_stays_and_a_menu_goes():
    lead, after = "There are two things that we shall look at here:", "Both of them are told of in the story, at length."
    items = "".join(f"<li><a href={x}>Thing {x}</a></li>" for x in "ab")
    assert html_extract.main_text(f"<h1>Head</h1><p>{lead}</p><ul>{items}</ul><p>{after}</p>") == f"Head\n{lead}\nThing a\nThing b\n{after}"
    assert html_extract.main_text(f"<h1>Head of it</h1><ul>{items}</ul><p>{lead}</p><p>{after}</p>") == f"Head of it\n{lead}\n{after}"
    assert html_extract.main_text(f"<p>{lead}</p><nav><ul>{items}</ul></nav><p>{after}</p>") == f"{lead}\n{after}"


def test_names_of_tools_in_an_article_are_judged_by_what_they_hold():
    share = "To share is to give a part of what one has to others, and all who did so in the long history of the town were glad of it in the end."
    login = "A login is what lets you in, and this text explains how it came to be that we all have so very many of them today."
    page = (f'<article><h1>Head</h1><p class="share">{share}</p><div class="share"><a href=1>Tweet</a> <a href=2>Mail</a></div>'
            f'<div class="share">Share this with friends.</div><p class=login>{login}</p><div class=comments><p>{share}</p></div></article>')
    assert html_extract.main_text(page) == f"Head\n{share}\n{login}"


@pytest.mark.parametrize("part", ["<b class=x>w</i> ", "<b class=x><h1>w", "<div><i class=y>w</p></li></em>", "<form><p class=share>w "])
def test_bad_markup_takes_time_in_proportion(part):
    began = time.process_time()
    html_extract.main_text("<p><td>" + part * 20_000)
    assert time.process_time() - began < 12


def test_form_around_the_whole_page():
    story = [f"Part {i} of the story is told here in full, with all the words that it takes to tell it." for i in range(6)]
    page = ('<body><form method="post" id="aspnetForm"><input type="hidden" name="__VIEWSTATE" value="x"><input type=hidden name=y>'
            '<div class="top"><label for=q>Search this site</label> <input name=q id=q><button>Go</button></div>'
            '<nav><a href=1>One</a> <a href=2>Two</a></nav><div class="content"><h1>Head of it</h1>' + "".join(f"<p>{x}</p>" for x in story)
            + '</div><fieldset><legend>Your letter to us</legend><p>Enter your name here, please.</p><label>Name <input name=n></label>'
            '<label>Mail <input name=m></label></fieldset></form></body>')
    assert html_extract.main_text(page) == "\n".join(["Head of it", *story])
    plain = page.replace('class="content"', 'class="c1"')
    assert html_extract.main_text(plain) == "\n".join(["Head of it", *story])


def test_forms_for_their_controls_are_left_out():
    story = "".join(f"<p>Part {i} of the story is told here in full, with all its words.</p>" for i in range(3))
    form = ('<form><p>Write to us whenever you like, and we will answer your letter soon.</p><label>Name</label><input name=n><label>Mail</label>'
            '<input name=m><select name=s><option>One</option></select><textarea name=t></textarea><button>Send</button></form>')
    want = html_extract.main_text(f'<div class="content">{story}</div>')
    assert want.count("\n") == 2
    for page in (f'<div class="content">{story}</div>{form}', f'<div class="content">{story}{form}</div>', f"<article>{story}{form}</article>"):
        assert html_extract.main_text(page) == want


def test_extract_on_odd_pages(spark):
    long = "<article>" + "".join(f"<p>Paragraph {i} with some words in it.</p>" for i in range(20_000)) + "</article>"
    rows = [(1, "u", None), (2, None, ""), (None, "u", "<p>"), (4, "u", PAGE), (4, "u", PAGE), (5, "u", long), (6, "u", "<article><p>cut off &am"),
            (7, "u", '<article><p>kept</p><a href="no end'), (8, "u", "a < b and c > d are words of a text.")]
    pages = pages_of(spark, rows)
    got = [tuple(r) for r in pages.select("page_id", html_extract.extract("html").alias("m")).select("page_id", "m.text", "m.n_chars").collect()]
    assert [t for _, t, _ in got[:3]] == ["", "", ""] and got[3] == got[4] and all(len(t) == n for _, t, n in got)
    assert got[5][1].count("\n") == 19_999 and [t for _, t, _ in got[6:]] == ["cut off &am", "kept", "a < b and c > d are words of a text."]
    assert pages.limit(0).select(html_extract.extract("html")).count() == 0


LONG, SHORT = "é" * 60, "x" * 99
ROWS = [(5, "u5", LONG), (3, "u\r\n3", LONG), (9, None, LONG), (None, "u", LONG), (4, "u4", SHORT), (6, "u6", SHORT), (7, "u7", None), (8, "u8", ""),
        (1, "u1", "y" * 200_000), (2, "u2", "y" * 100), (3, "again", LONG)]


def test_round_trip(spark):
    got = warc.round_trip(pages_of(spark, ROWS)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
    sha = lambda h: hashlib.sha256((h or "").encode()).hexdigest()
    want = []
    for page_id, _, html in ROWS:
        revisit = html == LONG and page_id != 3
        want.append((page_id, len((html or "").encode()), sha(html), "revisit" if revisit else "response", 3 if revisit else None))
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    assert warc.round_trip(pages_of(spark, ROWS).limit(0)).count() == 0


def test_sql_twin_agrees_where_ids_are_unique(spark):
    docs = pages_of(spark, [r for r in ROWS if r[0] is not None and r[1] != "again"])
    pages = docs.select("page_id", "url", "html").toArrow()  # noqa: F841
    got = warc.round_trip(docs).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    key = lambda r: tuple((x is None, x or 0) for x in r)
    twin = duckdb.sql(warc.SQL).project("page_id, payload_bytes, payload_digest, record_type, refers_to").fetchall()
    assert sorted(map(tuple, got.collect()), key=key) == sorted(twin, key=key)


def test_index_reads_single_records(spark):
    folder = run_folder(spark, "test-warc")
    index = warc.write_archives(pages_of(spark, [(i, f"u{i}", f"{i} " * 500) for i in range(200)]).repartition(2), folder, archive_bytes=4_000)
    assert index.select("archive").distinct().count() > 4
    some = index.where("page_id % 17 = 0")
    for gap in (0, 1 << 20):
        read = warc.read_records(some, folder, gap=gap, run_bytes=8_000, segment_bytes=5_000).collect()
        assert {(r["page_id"], bytes(r["payload"]).decode()) for r in read} == {(i, f"{i} " * 500) for i in range(0, 200, 17)}
    row = index.where("page_id = 5").first()
    with open(f"{folder.removeprefix('file:')}/{row['archive']}", "rb") as archive:
        archive.seek(row["offset"])
        raw = zlib.decompress(archive.read(row["length"]), 31)
    assert raw.startswith(b"WARC/1.0\r\nWARC-Type: response\r\n") and raw.endswith(b"\r\n\r\n") and warc.parse(raw)["url"] == "u5"
