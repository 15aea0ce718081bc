"""HTML extraction against pages made with known main text."""

import random
import time
import tracemalloc
from html import escape

from lexigauge.llm import html_extract

SCHEMA = "page_id long, url string, html string"


def make(rng, host, i):
    """Page and main text of a host: each host has its own layout, some without any telling names."""
    word = lambda: "".join(rng.choice("abcdeio&<é ") for _ in range(rng.randint(2, 8))).strip() or "x"
    text = lambda n: " ".join(" ".join(word() for _ in range(n)).split())
    links = "".join(f'<li><a href="/{k}">{escape(text(2))}</a></li>' for k in range(6))
    blocks = [text(rng.randint(1, 60)) for _ in range(rng.randint(1, 9))]
    inner = "".join(rng.choice(["<p>{}</p>", "<p>{}", "<h2>{}</h2>", "<blockquote>{}</blockquote>", "<ul><li>{}</ul>", '<p class="warning">{}</p>', "<div class='tags'>{}</div>"]).format(escape(b)) for b in blocks)
    head = f"<!doctype html><html><head><title>{escape(text(3))}</title><style>p{{}}</style><script>var a = '</p><p>no';</script></head>"
    notice, reader = escape(text(12)), escape(text(15))
    wrap = [
        f"<body><nav><ul>{links}</ul></nav><article>{inner}</article><aside>{notice}</aside><footer>{notice}</footer>",
        f"<body><div class='menu{i}'>{links}</div><div id=main>{inner}</div><div class='cookie notice'>{notice}</div><div id='comments'><p>{reader}</div>",
        f"<body><header>{notice}</header><main><article><header>{inner}</header></article></main><form>{notice}<label>{notice}</label></form><div role=banner>{notice}</div>",
        f"<body><table><tr><td class=nav>{links}<td class=c{i}>{inner}<td class=advert>{notice}</table><!-- {notice} --><div hidden>{notice}</div>",
    ]
    return head + wrap[host], " ".join(blocks)


def test_known_main_text(spark):
    rng = random.Random(1)
    made = [make(rng, i % 4, i) for i in range(200)]
    rows = [(i, f"http://host{i % 4}.example/{i}", html) for i, (html, _) in enumerate(made)]
    got = {r["page_id"]: r for r in html_extract.extract(spark.createDataFrame(rows, SCHEMA)).collect()}
    hits = sum(got[i]["text"] == text for i, (_, text) in enumerate(made))
    assert hits == len(made)
    assert all(r["n_chars"] == len(r["text"]) for r in got.values())


def test_marks_and_references():
    page = '<html><body><nav>menu</nav><div class="ad">buy</div><article><h1>Title</h1><p>One <b>bold</b>\n two &amp; three<p>Four<div class="comments">no</div></article><footer>end</footer>'
    assert html_extract.main_text(page, None) == "Title One bold two & three Four"
    assert html_extract.main_text(None, None) == "" and html_extract.main_text("a < b", None) == "a < b"
    assert html_extract.main_text("<p title='a > b' it's>don't</p>", None) == "don't"


def test_articles_lose_nothing_by_names():
    page = '<article><header><h2>Head</h2></header><p class="warning">Storm warning issued.</p><div class="tags">two tags</div><label>Label</label></article><header>no</header>'
    assert html_extract.main_text(page, None) == "Head Storm warning issued. two tags Label"


def test_siblings_of_the_winner(spark):
    page = lambda i: f"<body><div class=a><p>{'story ' * 30}</div><div class=b><p>{'more ' * 3}</div><ul>{'<li><a href=x>link</a>' * 9}</ul></body>"
    rows = [(i, "http://a.example/1", page(i)) for i in range(5)]
    assert all("story" in r["text"] and "more" in r["text"] and "link" not in r["text"] for r in html_extract.extract(spark.createDataFrame(rows, SCHEMA)).collect())


def test_odd_pages(spark):
    twin = "<body><div class=a>same text</div><div class=a>same text</div></body>"
    rows = [(1, None, None), (2, "", ""), (3, "no url", "plain"), (4, "http://h.example", twin), (4, "http://h.example", twin), (None, "http://h.example", "<div>" * 50 + "x")]
    frame = spark.createDataFrame([(*r, "path", 1) for r in rows], SCHEMA + ", path string, host int")
    got = [(r["page_id"], r["text"]) for r in html_extract.extract(frame).collect()]
    assert sorted(got, key=repr) == sorted([(1, ""), (2, ""), (3, "plain"), (4, "same text same text"), (4, "same text same text"), (None, "x")], key=repr)
    assert html_extract.extract(frame.limit(0)).count() == 0


def test_deep_and_long_pages_take_linear_time():
    for piece, close in (("<span>x ", ""), ("<div>x </b>", ""), ("<b it's \"x>y ", ""), ("<p>x<td>", ""), ("<!-- x", "")):
        took = []
        for n in (4_000, 32_000):
            began = time.process_time()
            html_extract.main_text("<body>" + piece * n + close, None)
            took.append(time.process_time() - began)
        assert took[1] < 30 * max(took[0], 0.02)
    tracemalloc.start()
    text = html_extract.main_text("<body>" + "<span>x " * 125_000, None)
    assert tracemalloc.get_traced_memory()[1] < 200e6 and text == " ".join(["x"] * 125_000)
    tracemalloc.stop()
