"""Main text of web pages by a linear-chain conditional random field over leaf blocks, decoded by Viterbi."""

from __future__ import annotations

import random
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.llm.common import arrow_batches, rows, table
from assayer.llm.html_blocks import FEATURES, blocks

#: Stands in the main blocks of the labelled pages, and is cut out before features are taken.
MARK = "⁣"
TRAINING_PAGES, ROUNDS, RATE, SHRINK = 600, 25, 0.3, 1e-4


def _prose(rng: random.Random, low: int, high: int, stop: bool = True) -> str:
    words = ["".join(rng.choice("aeiouéü") + rng.choice("bcdfglmnprst") for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(low, high))]
    text = " ".join(w + ("," if rng.random() < 0.08 else ". " if rng.random() < 0.06 else "") for w in words)
    return (text[:1].upper() + text[1:] + ("." if stop else "")).replace(". .", ".").replace(",.", ".")


#: Shapes of made-up pages with their weights: parts with names, layout by tables, and loose tags without names.
SHAPES = {"named": 8, "table": 1, "loose": 1}


def labelled_page(rng: random.Random, shape: str | None = None) -> tuple[str, str]:
    """A made-up page and its main text; templates, names and nesting vary, and some pages are damaged."""
    shape = shape or rng.choices(list(SHAPES), list(SHAPES.values()))[0]
    main: list[str] = []

    def keep(text: str) -> str:
        main.append(text)
        return MARK + text

    def menu(tag: str) -> str:
        links = [f"<li><a href='/{k}'>{_prose(rng, 1, 3, False)}</a></li>" for k in range(rng.randint(3, 8))]
        return rng.choice([f"<{tag}><ul>{''.join(links)}</ul></{tag}>", f"<div class='{rng.choice(['menu', 'navbar', 'nav-links', 'navigation'])}'><ul>{''.join(links)}</ul></div>", f"<{tag}>{''.join(x.replace('li>', 'span>') for x in links)}</{tag}>"])

    def junk() -> str:
        kind = rng.randrange(9)
        long = _prose(rng, 3, rng.choice([8, 40]))
        if kind == 0:
            return f"<div class='{rng.choice(['ad', 'ads', 'advert', 'sponsored', 'promo banner', 'advertisement'])}'>{rng.choice([long, f'<p>{long}</p>', f'<a href=x>{long}</a>'])}</div>"
        if kind == 1:
            return f"<div class='{rng.choice(['cookie-notice', 'cookie', 'notice', 'consent-banner', 'gdpr', 'alert'])}'><p>{long}</p><button>OK</button></div>"
        if kind == 2:
            return f"<aside>{''.join(f'<h3>{_prose(rng, 1, 4, False)}</h3><p>{_prose(rng, 4, 30)}</p>' for _ in range(rng.randint(1, 3)))}</aside>"
        if kind == 3:
            return f"<div {rng.choice(['class', 'id'])}='{rng.choice(['sidebar', 'widget', 'side-widget', 'related', 'recommended'])}'><h4>{_prose(rng, 1, 3, False)}</h4><ul>{''.join(f'<li><a href=y>{_prose(rng, 2, 7, False)}</a></li>' for _ in range(4))}</ul><p>{long}</p></div>"
        if kind == 4:
            return f"<form action='/s'><label>{_prose(rng, 1, 4, False)}</label><input name=q><p>{_prose(rng, 3, 20)}</p><button>Go</button></form>"
        if kind == 5:
            return f"<div class='{rng.choice(['newsletter', 'subscribe', 'signup', 'share', 'social-share'])}'>{long}</div>"
        if kind == 6:
            return f"<{rng.choice(['script', 'style', 'noscript'])}>{long} &lt;p&gt;</script></style></noscript>"
        if kind == 7:
            return f"<!-- {long} <p>{long}</p> -->"
        return menu("nav")

    def comments() -> str:
        each = "".join(f"<{tag} class='comment'><p>{_prose(rng, 4, 50)}</p></{tag}>" for tag in [rng.choice(["div", "li", "article"])] for _ in range(rng.randint(1, 6)))
        return rng.choice([f"<section class='comments'><h2>{_prose(rng, 1, 3, False)}</h2>{each}</section>", f"<div id='comments'>{each}</div>", f"<ol class='comment-list'>{each}</ol>", f"<div class='discussion replies'><p>{_prose(rng, 4, 30)}</p><p>{_prose(rng, 4, 30)}</p></div>"])

    def paragraph() -> str:
        text = _prose(rng, rng.choice([1, 5, 20]), rng.choice([25, 60, 120]))
        kind = rng.randrange(16)
        if kind >= 14 or plain:
            tag = rng.choice(["div", "p", "section", "dd"] if plain else ["div", "div class='paragraph'", "section"])
            return f"<{tag}>{keep(text)}</{tag.split()[0]}>"
        if kind == 0:
            return f"<h2>{keep(_prose(rng, 1, 7, False))}</h2>"
        if kind == 1:
            return f"<ul>{''.join(f'<li>{keep(_prose(rng, 2, 18))}</li>' for _ in range(rng.randint(2, 4)))}</ul>"
        if kind == 2:
            return f"<blockquote><p>{keep(text)}</p></blockquote>"
        if kind == 3:
            first, rest = text[:5], text[5:]
            return f"<p>{keep(text)[:6]}<a href='z'>{rest[:12]}</a>{rest[12:]}</p>" if first.strip() == first and rest[:12].strip() == rest[:12] else f"<p>{keep(text)}</p>"
        if kind == 4:
            return f"<table><tr><td>{keep(_prose(rng, 1, 5, False))}</td><td>{keep(_prose(rng, 1, 5, False))}</td></tr></table>"
        if kind == 5:
            return f"<pre>{keep(text)}</pre>"
        if kind == 6:
            return f"<p><b>{keep(text)}<br><p>"
        return f"<p>{keep(text)}" + ("</p>" if rng.random() < 0.9 else "")

    def links(between: str, low: int = 3, high: int = 9) -> str:
        return between.join(f"<a href='/{k}'>{_prose(rng, 1, 3, False)}</a>" for k in range(rng.randint(low, high)))

    def code() -> str:
        return rng.choice(["<script>for(i=0;i<n;i++)go('</p>');</script>", "<script async src=x></script>", "<style>a<b{}</style>", "<!-- <p>no</p> -->"])

    if shape == "table":
        content = "".join(f"<p>{keep(_prose(rng, rng.choice([2, 20]), rng.choice([30, 90])))}</p>" if rng.random() < 0.8 else f"<h3>{keep(_prose(rng, 1, 6, False))}</h3>" for _ in range(rng.randint(2, 9)))
        head = f"<tr><td colspan=3><b>{_prose(rng, 1, 4, False)}</b> {links(' | ')}</td></tr>"
        side = f"<td valign=top width=150>{links('<br>', 4, 12)}</td>"
        foot = f"<tr><td colspan=3>{links(' - ', 2, 5)}<br>&copy; {rng.randint(1995, 2025)} {_prose(rng, 1, 5)}</td></tr>"
        more = f"<td width=120>{code()}<a href=x>{_prose(rng, 2, 6, False)}</a></td>" if rng.random() < 0.5 else ""
        page = f"<html><head><title>{_prose(rng, 2, 6, False)}</title><body bgcolor=white><table width=100%>{head}<tr>{side}<td>{content}</td>{more}</tr>{foot}</table>"
        return page, "\n".join(" ".join(t.split()) for t in main)
    if shape == "loose":
        heading = keep(_prose(rng, 2, 8, False))
        content = "".join(code() * (rng.random() < 0.3) + (f"<p>{keep(_prose(rng, rng.choice([3, 20]), rng.choice([30, 90])))}" if rng.random() < 0.85 else f"<h2>{keep(_prose(rng, 1, 6, False))}</h2>") for _ in range(rng.randint(2, 9)))
        talk = f"<h3>{rng.randint(1, 40)} Comments</h3><dl>{''.join(f'<dt>{_prose(rng, 1, 2, False)}:<dd>{_prose(rng, 3, 30)}' for _ in range(rng.randint(1, 5)))}</dl>" if rng.random() < 0.4 else ""
        page = f"<!DOCTYPE html><title>{_prose(rng, 2, 6, False)}</title><meta charset=utf-8>{code()}<p>{links(' | ')}<h1>{heading}</h1>{content}{talk}<hr><p>&copy; {_prose(rng, 1, 6)} {links(' &middot; ', 1, 4)}"
        return page, "\n".join(" ".join(t.split()) for t in main)
    plain = rng.random() < 0.12
    inside = [paragraph if rng.random() < 0.9 else junk for _ in range(rng.randint(0 if rng.random() < 0.05 else 2, 14))]
    title = _prose(rng, 2, 9, False)
    wrap = rng.choice(["article", "main", "div class='content'", "div id='main-content'", "div class='post-body'", "section class='entry'", "div class='story text'", "div id='content'", "div", "div", "td", "center", "body", "body"])
    parts = ["<!DOCTYPE html><html><head><meta charset='utf-8'><title>", title, "</title><style>p{margin:0}</style></head><body>"]
    bare = rng.random() < 0.08
    if bare:
        pass
    elif rng.random() < 0.5:
        parts.append(f"<header><{(h := rng.choice(['h1', 'div', 'p']))}>{_prose(rng, 1, 5, False)}</{h}>{menu('nav') if rng.random() < 0.6 else ''}</header>")
    elif rng.random() < 0.8:
        parts.append(menu("nav"))
    parts += [junk() for _ in range(0 if bare else rng.randint(0, 3))]
    content = [f"<{(h := rng.choice(["h1", "h1", "h2"]))}>{keep(title)}</{h}>"] if inside and rng.random() < 0.8 else []
    content += [f() for f in inside]
    if rng.random() < 0.25:
        content.append(comments())
    name = wrap.split()[0]
    parts += ["<table><tr>" if name == "td" else "", "" if name == "body" else f"<{wrap}>", *content, "" if name == "body" else f"</{name}>", "</tr></table>" if name == "td" else ""]
    if rng.random() < 0.35:
        parts.append(comments())
    parts += [junk() for _ in range(0 if bare else rng.randint(0, 3))]
    if not bare and rng.random() < 0.85:
        parts.append(rng.choice([f"<footer>&copy; {_prose(rng, 1, 4, False)} &middot; {_prose(rng, 2, 20)}</footer>", f"<div class='footer'><p>&copy; {_prose(rng, 1, 8, False)}</p><p>{_prose(rng, 2, 15)}</p></div>", f"<footer><p>{_prose(rng, 2, 20)}</p>{menu('nav')}</footer>"]))
    parts.append("</body></html>" if rng.random() < 0.85 else "")
    return "".join(parts), "\n".join(" ".join(t.split()) for t in main)


class Field:
    """Weights of the features for a main block (against any other), of neighbouring labels, and of the first label."""

    def __init__(self, weights: np.ndarray, steps: np.ndarray, start: np.ndarray):
        self.weights, self.steps, self.start = weights.tolist(), steps.tolist(), start.tolist()

    def main(self, features: list[list[int]]) -> list[int]:
        """The most likely labels of a page's blocks (1: main text), by Viterbi; ties go to 0."""
        if not features:
            return []
        w, (aa, ab), (ba, bb) = self.weights, *self.steps
        a, b = self.start[0], self.start[1] + sum(w[f] for f in features[0])
        back: list[tuple[int, int]] = []
        for fs in features[1:]:
            gain = sum(w[f] for f in fs)
            to_a = (0, a + aa) if a + aa >= b + ba else (1, b + ba)
            to_b = (0, a + ab) if a + ab >= b + bb else (1, b + bb)
            back.append((to_a[0], to_b[0]))
            a, b = to_a[1], to_b[1] + gain
        label = int(b > a)
        out = [label]
        for step in reversed(back):
            label = step[label]
            out.append(label)
        return out[::-1]


def fit(pages: list[tuple[list[list[int]], list[int]]], rounds: int = ROUNDS, seed: int = 5) -> Field:
    """Maximum likelihood over (features, labels) of pages, by stochastic gradients scaled by what each weight has seen."""
    weights, steps, start = np.zeros(len(FEATURES)), np.zeros((2, 2)), np.zeros(2)
    seen = [np.full(x.shape, 1e-6) for x in (weights, steps, start)]
    rng = random.Random(seed)
    pages = [p for p in pages if p[0]]
    for _ in range(rounds):
        rng.shuffle(pages)
        for features, labels in pages:
            n = len(features)
            emit = np.zeros((n, 2))
            emit[:, 1] = [weights[f].sum() for f in features]
            forward, backward = np.zeros((n, 2)), np.zeros((n, 2))
            forward[0] = start + emit[0]
            for k in range(1, n):
                forward[k] = np.logaddexp(forward[k - 1, 0] + steps[0], forward[k - 1, 1] + steps[1]) + emit[k]
            for k in range(n - 2, -1, -1):
                ahead = backward[k + 1] + emit[k + 1]
                backward[k] = np.logaddexp(steps[:, 0] + ahead[0], steps[:, 1] + ahead[1])
            whole = np.logaddexp(*forward[-1])
            chance = np.exp(forward + backward - whole)
            pull = [np.zeros_like(x) for x in (weights, steps, start)]
            for k, f in enumerate(features):
                pull[0][f] += labels[k] - chance[k, 1]
            if n > 1:
                pair = np.exp(forward[:-1, :, None] + steps + (emit + backward)[1:, None, :] - whole)
                pull[1] -= pair.sum(0)
                np.add.at(pull[1], (labels[:-1], labels[1:]), 1)
            pull[2] -= chance[0]
            pull[2][labels[0]] += 1
            for x, g, s in zip((weights, steps, start), pull, seen, strict=True):
                g -= SHRINK * x
                s += g * g
                x += RATE * g / np.sqrt(s)
    return Field(weights, steps, start)


@lru_cache(maxsize=2)
def trained(pages: int = TRAINING_PAGES, seed: int = 1) -> Field:
    """The field fitted on so many labelled pages."""
    rng = random.Random(seed)
    examples = []
    for _ in range(pages):
        page, _ = labelled_page(rng)
        found = blocks(page)
        plain = blocks(page.replace(MARK, ""))
        examples.append(([f for _, f in plain], [int(MARK in t) for t, _ in found]))
    return fit(examples)


def main_text(page: str, field: Field) -> str:
    """The main blocks of a page, one a line."""
    found = blocks(page)
    return "\n".join(t for (t, _), keep in zip(found, field.main([f for _, f in found]), strict=True) if keep)


EXTRACTED = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])


def _extracted(field):
    def run(batches):
        def records():
            for key, url, page in rows(batches, "id", "url", "html", step=64):
                text = main_text(page, field.value)
                yield key, url, text, len(text)

        yield from arrow_batches(records(), EXTRACTED, 512)

    return run


def extract(pages: DataFrame, field: Field | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: page_id, url, text, n_chars (code points of the text).

    A null or empty page, and one without a main block, has an empty text. Blocks are joined by a line feed in page order;
    repeated pages each get their row; null ids and urls stay; other columns are left out.
    """
    shared = pages.sparkSession.sparkContext.broadcast(field or trained())  # as long as the list of features
    own = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    return own.mapInArrow(_extracted(shared), "page_id long, url string, text string, n_chars long")


def op9(spark, sf_dir):
    return extract(table(spark, sf_dir, "pages"))
