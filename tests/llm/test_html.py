import random

import numpy as np
import pytest

from assayer.llm import html_blocks, html_extract
from assayer.llm.html_extract import MARK, Field


@pytest.fixture(scope="module")
def field():
    return html_extract.trained()


def measured(field, pages):
    """(share of pages that are exact, wrong blocks for each right one)."""
    right = blocks = wrong = 0
    for page, want in pages:
        got = html_extract.main_text(page.replace(MARK, ""), field)
        right += got == want
        a, b = set(got.split("\n")), set(want.split("\n"))
        blocks, wrong = blocks + len(b), wrong + len(a ^ b)
    return right / len(pages), wrong / blocks


def test_held_out_pages(field):
    rng = random.Random(99)
    right, wrong = measured(field, [html_extract.labelled_page(rng, "named") for _ in range(200)])
    assert right >= 0.95 and wrong <= 0.01
    for shape in ("table", "loose"):
        right, wrong = measured(field, [html_extract.labelled_page(rng, shape) for _ in range(100)])
        assert right >= 0.9 and wrong <= 0.03, (shape, right, wrong)


def unseen_page(rng, shape):
    """A page of a template that no training page has."""
    prose, main = html_extract._prose, []

    def keep(text):
        main.append(" ".join(text.split()))
        return text

    article = f"<h1>{keep(prose(rng, 2, 8, False))}</h1>" + "".join(f"<p>{keep(prose(rng, 12, 70))}</p>" for _ in range(rng.randint(2, 8)))
    links = "".join(f"<a class=item href=/{k}>{prose(rng, 1, 3, False)}</a>" for k in range(6))
    if shape == "roles":
        return f"<body><div role=banner><div>{prose(rng, 1, 3, False)}</div><div role=navigation>{links}</div></div><div role=main>{article}</div><div role=complementary><div>{links}</div></div><div role=contentinfo>&copy; {prose(rng, 2, 6)}</div>", "\n".join(main)
    return f"<body><div id=wrap><div class=row><div class=top-menu>{links}</div></div><div class=row><div class=col-8>{article}</div><div class=col-4 id=sidebar><h4>{prose(rng, 1, 3, False)}</h4>{links}</div></div><div class='row footer-row'><small>&copy; {prose(rng, 2, 6)}</small></div></div>", "\n".join(main)


@pytest.mark.parametrize("shape", ["roles", "columns"])
def test_templates_that_training_never_saw(field, shape):
    rng = random.Random(5)
    right, wrong = measured(field, [unseen_page(rng, shape) for _ in range(100)])
    assert right >= 0.8 and wrong <= 0.05, (right, wrong)


def test_viterbi_finds_the_best_labels():
    rng = np.random.default_rng(0)
    for n in range(1, 9):
        field = Field(rng.normal(size=12), rng.normal(size=(2, 2)), rng.normal(size=2))
        features = [rng.choice(12, rng.integers(1, 5), replace=False).tolist() for _ in range(n)]

        def total(labels):
            gain = field.start[labels[0]] + sum(field.weights[f] for x, fs in zip(labels, features) if x for f in fs)
            return gain + sum(field.steps[a][b] for a, b in zip(labels, labels[1:]))

        best = max(([k >> i & 1 for i in range(n)] for k in range(1 << n)), key=total)
        assert total(field.main(features)) == pytest.approx(total(best))
    assert field.main([]) == []


@pytest.mark.parametrize(
    "page, texts",
    [
        ("", []),
        ("plain", ["plain"]),
        ("<p>a<p>b &amp; c&nbsp;&#100;<br>e</p>", ["a", "b & c d e"]),
        ("<div>x<ul><li>1<li>2</ul>y</div>", ["x", "1", "2", "y"]),
        ("<script>if (a < b) '</p>'</script><p title='a>b'>t</p><!-- <p>no</p> --><style>x", ["t"]),
        ("<p>cut <b>off", ["cut off"]),
        ("<p>a < b</p><p>c <", ["a < b", "c <"]),
        ("<table><tr><td>1<td>2<tr><th>3</table>", ["1", "2", "3"]),
        ("</div></p><p>t", ["t"]),
        ("<p>\n  many \t spaces  \n</p><p> </p>", ["many spaces"]),
        ("<title>no</title><textarea>no</textarea><p>yes", ["yes"]),
    ],
)
def test_blocks(page, texts):
    assert [t for t, _ in html_blocks.blocks(page)] == texts


@pytest.mark.parametrize(
    "page, texts",
    [
        ("<script>for(i=0;i<n;i++)go();</script><p>t<script>x</script>", ["t"]),
        ("<style>a<b{}</style><title>a <b</title><p>t</p><textarea><q</textarea>", ["t"]),
        ("<html><head><title>no</title><meta charset=x><body><p>t", ["t"]),
        ("<head><script>'</head><p>no'</script><title>no</title><p>t</p>", ["t"]),
        ("<head><noscript><p>no</p></noscript></head><p>t</p>", ["t"]),
        ("<div><noscript><div>no</div>no</div><p>t</p>", ["t"]),
        ("<article><p>a<svg><path></article><p>t</p>", ["a", "t"]),
    ],
)
def test_skipped_elements_end(page, texts):
    assert [t for t, _ in html_blocks.blocks(page)] == texts


@pytest.mark.parametrize(
    "page, texts",
    [
        ("<body><script>if(a<b){x=1}</script><p>Hello there.</p>", ["Hello there."]),
        ("<script>var s='it<i';</script><p>Hello there.</p>", ["Hello there."]),
        ("<script><!-- x </script><p>Hello there.</p>", ["Hello there."]),
        ("<html><head><title>x</title><meta charset=utf-8><body><h1>T</h1><p>Hello there.</p>", ["T", "Hello there."]),
        ("<body><select><option>a<option>b<p>t</p>", ["t"]),
        ("<div><select><option>a</select><p>t</p><iframe src=x><p>u</p>", ["t", "u"]),
        ("<body><noscript><p>t</p>", ["t"]),
        ("<p>a <math><mi>x</mi><mo>=</mo><mn>2</mn></math> b<object data=x>c</object></p>", ["a x=2 b", "c"]),
        ("<p>t</p><script>var a = 1; <p>u</p>", ["t", "u"]),
        ("<svg><title>no</title><text>no</text></svg><template><p>no</p></template><p>t", ["t"]),
        ("<video><p>no</p></video><canvas>no</canvas><p>t", ["t"]),
    ],
)
def test_malformed_pages_lose_nothing(page, texts):
    assert [t for t, _ in html_blocks.blocks(page)] == texts


def test_damaged_pages_against_a_slow_reading():
    """Pages of plain parts with scripts, styles, titles and comments between, whose tags are left out or unclosed at random: all visible words stay, in order."""
    rng = random.Random(7)
    hidden = ["<script>if(a<b){go('</p>')}</script>", "<style>p<b{}</style>", "<!-- <p>zz</p> -->", "<script><!-- zz </script>", "<noscript><p>zz</p></noscript>", "<svg><text>zz</text></svg>", "<template><p>zz</p></template>", "<script>s='it<i'</script>"]
    for _ in range(60):
        words = [f"w{k}" for k in range(rng.randint(1, 30))]
        body = []
        for w in words:
            tag = rng.choice(["p", "div", "li", "h2", "td", "section", "b", "span"])
            body.append(rng.choice([f"<{tag}>{w}</{tag}>", f"<{tag}>{w}", f"<{tag} title='a>b'>{w}</{tag}>", f"</{tag}>{w} "]) + " ")
            if rng.random() < 0.3:
                body.append(rng.choice(hidden))
        head = rng.choice(["", "<head><title>zz</title>", "<html><head><meta charset=x><style>q<r{}</style></head><body>", "<!DOCTYPE html><html>"])
        page = head + "".join(body) + rng.choice(["", "</body></html>", "<select><option>zz"])
        assert " ".join(t for t, _ in html_blocks.blocks(page)).split() == words, page


def test_many_unclosed_elements_take_linear_time():
    html_blocks.blocks("<svg>" * 60_000 + "<iframe>" * 60_000 + "<script>" * 60_000)


def test_very_long_pages(field):
    page = "<article><h1>Title of it</h1><p>" + "words and more, " * 40_000 + "end.</p><p>" + "x" * 50_000 + "</p></article>"
    assert len(html_extract.main_text(page, field)) > 600_000


def test_unclosed_quotes_take_linear_time():
    html_blocks.blocks("<p title='" + "a b=\"c " * 50_000)
    html_blocks.blocks("<div " * 50_000)


def test_pages(spark, field):
    page = (
        "<html><body><header><h1>Site</h1><nav><a href=/>Home</a></nav></header><div class='cookie'>We use cookies. Accept?</div>"
        "<article><h1>Real title</h1><p>Some text here, with words and more words.</p><form><input><button>Go</button>Your mail</form><p>Second.</p></article>"
        "<section id='comments'><h3>Comments</h3><p>Great article, thanks a lot for it.</p></section><aside><p>Read this other thing, it is long.</p></aside><footer>&copy; 2020</footer>"
    )
    rows = [(1, "u", page), (2, None, None), (3, "u", ""), (1, "u", page), (None, "u", "<nav>x</nav>")]
    df = spark.createDataFrame([(*r, "t") for r in rows], "page_id long, url string, html string, text string")
    want = "Real title\nSome text here, with words and more words.\nSecond."
    got = sorted((tuple(r) for r in html_extract.extract(df, field).collect()), key=str)
    assert got == sorted([(1, "u", want, len(want)), (2, None, "", 0), (3, "u", "", 0), (1, "u", want, len(want)), (None, "u", "", 0)], key=str)
    assert html_extract.extract(df.limit(0), field).collect() == []
