import itertools
import math
import random

import numpy as np
import pytest

from tagloom.llm import html_text

LONG = "A paragraph that is long enough to stand well above the threshold of its page, and then some more words."


@pytest.mark.parametrize("page, text", [
    ("<html><head><title>no</title><body><p>First</p><p>Second</p></body></html>", "First Second"),
    ("<head><title>no</title><meta charset=utf-8><p>First<p>Second", "First Second"),
    ("<head><title>no</title>Bare text", "Bare text"),
    ("<head><noscript><p>no</noscript></head><body><p>First</p>", "First"),
    ("<body><p>First</p><noscript><p>no</noscript><p>Second</p>", "First Second"),
    ("<body><button><div>no</button><p>First</p>", "First"),
    (f"<div><p>{LONG}</p></div>" + "".join(f"<div><p>{w}</p></div>" for w in ("One.", "Two.", "Three.", "Four.", "Five.")) + "<nav><p>Menu</p></nav>" + f"<div><p>{LONG}</p></div>", f"{LONG} One. Two. Three. Four. Five. {LONG}"),
])
def test_whole_text(page, text):
    assert html_text.extract(page) == text


LINKS = "<ul>" + "".join(f"<li><a href=x>Another story {i}</a></li>" for i in range(6)) + "</ul>"


@pytest.mark.parametrize("page, text", [
    (f"<article><h1>T</h1><p>{LONG}</p>{LINKS}<p>{LONG}</p></article>", f"T {LONG} {LONG}"),
    (f"<article><p>{LONG}</p><p><a href=x>One link.</a></p><p>{LONG}</p></article>", f"{LONG} One link. {LONG}"),
    (f"<article><div hidden>no</div><p>{LONG}</p></article>", LONG),
    (f"<article><p>{LONG}</p><p>{LONG}</p><p class=notice>Note this</p></article>", f"{LONG} {LONG}"),
    (f"<article><div class='article-header'><h1>Head</h1></div><p>{LONG}</p></article>", f"Head {LONG}"),
    (f"<article><div class='share-price-table'>5 euros</div><p>{LONG}</p></article>", f"5 euros {LONG}"),
    (f"<article><p>{LONG}</p><p>A.</p><p>B.</p><p>C.</p><p>D.</p><p>E.</p><p>F.</p><p>{LONG}</p></article>", f"{LONG} A. B. C. D. E. F. {LONG}"),
])
def test_ratios_and_structure(page, text):
    assert html_text.extract(page) == text


def test_very_long_page():
    assert html_text.extract("<article>" + f"<p>{LONG}</p>" * 20_000 + "</article>") == " ".join([LONG] * 20_000)


def test_ratios_decide(monkeypatch):
    """With every line taken for content, pages with an article give other texts."""
    page = f"<article><p>{LONG}</p>{LINKS}<p>{LONG}</p></article>"
    with_ratios = html_text.extract(page)
    monkeypatch.setattr(html_text, "content_lines", lambda lines: np.ones(len(lines), bool))
    assert html_text.extract(page) != with_ratios == f"{LONG} {LONG}"


def plain_content(lines):
    """Ratio, smoothing and threshold, line by line."""
    ratios = [w * max(0, len(t) - linked) / max(1, tags) for t, tags, linked, w, _ in lines]
    smoothed = []
    for i in range(len(lines)):
        near = [(math.exp(-0.5 * (j - i) ** 2), ratios[j]) for j in range(len(lines)) if abs(j - i) <= 3]
        smoothed.append(sum(a * r for a, r in near) / sum(a for a, _ in near))
    mean = sum(ratios) / len(ratios)
    threshold = min(0.5 * math.sqrt(sum((r - mean) ** 2 for r in ratios) / len(ratios)), max(smoothed))
    kinds = ["out" if w == 0 else "weak" if w < 1 else "links" if 2 * linked > len(t) else "text" for t, _, linked, w, _ in lines]
    found, usable = [False] * len(lines), [i for i, k in enumerate(kinds) if k != "out"]
    for _, group in itertools.groupby(usable, key=lambda i: kinds[i]):
        run = list(group)
        reached = max(smoothed[i] for i in run) if kinds[run[0]] == "text" else sum(smoothed[i] * lines[i][3] for i in run) / len(run)
        for i in run:
            found[i] = reached >= threshold - 1e-9
    return found


def test_content_equals_plain_version():
    rng = random.Random(4)
    for _ in range(300):
        lines = []
        for _ in range(rng.randint(1, 25)):
            text = "x" * rng.choice([1, 5, 40, 300])
            lines.append((text, rng.randint(0, 6), rng.choice([0, 0, len(text), len(text) // 3]), rng.choice([1.0, 1.0, 1.0, 0.1, 0.0]), 0))
        assert html_text.content_lines(lines).tolist() == plain_content(lines)
