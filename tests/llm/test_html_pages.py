"""Pages that tell nothing by names, with the text that is wanted; names on the main text itself; odd tables."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from corrigenda.llm import html_text


def sentence(rng, n):
    return " ".join("".join(rng.choice("abcdefghilmnorstu") for _ in range(rng.randint(2, 9))) for _ in range(n)).capitalize() + "."


def page(rng):
    """A page of plain blocks: link lists, short notes and a foot around one article; and the article's text."""
    blocks = []
    for _ in range(rng.randint(4, 12)):
        kind = rng.random()
        text = " ".join(sentence(rng, rng.randint(6, 18)) for _ in range(rng.randint(1, 5)))
        if kind < 0.15:
            blocks.append((f"<h2>{text[:30]}</h2>", [" ".join(text[:30].split())]))
        elif kind < 0.3:
            items = [sentence(rng, rng.randint(5, 12)) for _ in range(3)]
            blocks.append(("<ul>" + "".join(f"<li>{i}</li>" for i in items) + "</ul>", items))
        elif kind < 0.5:
            words = text.split(" ")
            words[2] = f'<a href="/x">{words[2]}</a>'
            blocks.append((f"<p>{' '.join(words)}</p>", [text]))
        else:
            blocks.append((f"<p>{text}</p>", [text]))
    links = lambda n: "".join(f'<div><a href="/{k}">{sentence(rng, rng.randint(1, 4))[:-1]}</a></div>' for k in range(n))
    inner = "".join(b for b, _ in blocks)
    for _ in range(rng.randint(1, 3)):
        inner = f"<div>{inner}</div>"
    side = f"<div>{links(rng.randint(5, 25))}</div>"
    foot = f"<div><div>{links(rng.randint(3, 9))}</div><div>{sentence(rng, 3)}</div></div>"
    before, after = (side, "") if rng.random() < 0.5 else ("", side)
    html = f"<html><head><title>{sentence(rng, 4)}</title></head><body><div>{links(rng.randint(4, 12))}</div><div>{before}{inner}{after}</div>{foot}</body></html>"
    return html, "\n".join(line for _, lines in blocks for line in lines)


def overlap(got, want):
    a, b = Counter(got.split()), Counter(want.split())
    return sum((a & b).values()), a.total(), b.total()


def test_words_of_pages_without_names(monkeypatch):
    rng = random.Random(50)
    pages = [page(rng) for _ in range(100)]
    got = [html_text.main_text(h) for h, _ in pages]
    hit, n, m = (sum(x) for x in zip(*(overlap(g, w) for g, (_, w) in zip(got, pages))))
    assert hit / n > 0.98 and hit / m > 0.98, (hit / n, hit / m)
    # the density decides: without it (the whole body taken) most pages come out differently
    monkeypatch.setattr(html_text, "_select", lambda body, nodes: [body])
    assert sum(html_text.main_text(h) != g for (h, _), g in zip(pages, got)) > 90


STORY = "<p>" + "</p><p>".join(f"This is sentence {k} of a story that goes on for a while, and then some more." for k in range(8)) + "</p>"
WANTED = "\n".join(f"This is sentence {k} of a story that goes on for a while, and then some more." for k in range(8))


@pytest.mark.parametrize(
    "html",
    [
        f'<body><nav><a href=/>home</a></nav><div class="post share">{STORY}</div></body>',
        f'<body><nav><a href=/>home</a></nav><main><section id="notice"><article>{STORY}</article></section></main></body>',
        f'<body><div id="widget-area"><div class="banner">{STORY}</div></div><footer>end</footer></body>',
        f"<body><article>{STORY.replace('<p>This is sentence 4', '<div class=widget><p>This is sentence 4').replace('</p><p>This is sentence 5', '</p></div><p>This is sentence 5')}</article></body>",
        f'<body><div class="comments sidebar"><h1 hidden>x</h1><article>{STORY}</article></div></body>',
    ],
)
def test_names_do_not_delete_the_article(html):
    assert html_text.main_text(html) == WANTED


@pytest.mark.parametrize(
    "noise",
    [
        '<div class="ad">Buy now, it is cheap and good, and there are only a few of them left.</div>',
        '<div class="comments"><p>I do not agree with the story at all, and I say so at some length here.</p></div>',
        '<div id="cookie-notice"><p>We keep small files on your machine to know you when you come again.</p></div>',
        '<aside><p>Other stories that you may want to read when this one is done with you.</p></aside>',
        '<div role="navigation"><a href=/a>here</a> or <a href=/b>there</a></div>',
        '<form><p>Your name and what you think of us, if you please.</p><input></form>',
        '<div class="related-posts"><ul><li><a href=/1>one more story</a></li></ul></div>',
        '<div hidden><p>Nobody can see this paragraph unless the page has been changed.</p></div>',
    ],
)
def test_noise_goes_inside_and_outside(noise):
    half = STORY.index("<p>This is sentence 4")
    for html in (f"<body><article>{STORY[:half]}{noise}{STORY[half:]}</article></body>", f"<body>{noise}<article>{STORY}</article></body>", f"<body><div>{STORY}</div>{noise}</body>"):
        assert html_text.main_text(html) == WANTED


def test_tables(spark):
    schema = "page_id bigint, url string, html string, text string, n_chars string"
    rows = [(1, "u", f"<body>{STORY}</body>", "clash", "x")] * 3 + [(None, None, None, None, None), (2, "u", "", "", ""), (3, "u", "no markup &amp; more", "", "")]
    got = html_text.extract_pages(spark.createDataFrame(rows, schema))
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    assert sorted(((r.page_id or 0, r.text, r.n_chars) for r in got.collect())) == sorted([(1, WANTED, len(WANTED))] * 3 + [(0, "", 0), (2, "", 0), (3, "no markup & more", 16)])
    assert html_text.extract_pages(spark.createDataFrame([], schema)).count() == 0
    long = spark.range(1).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.concat(F.lit("<body>"), F.repeat(F.lit(STORY), 5000)).alias("html"))
    assert html_text.extract_pages(long).first().n_chars == (len(WANTED) + 1) * 5000 - 1
