"""Line-block distribution (operator 9): the line rule against plain loops, and pages on which only the blocks tell text."""

import random

import pytest
from test_operators import prose

from pageloom.llm import html_text


def plain_stretches(lines):
    """Each line's block is the sum over its window, links out; a stretch rises from nothing and ends where a block dives to nothing."""
    weigh = lambda line, links: len(line[0]) if links or line[1] <= 0.5 * len(line[0]) else 0
    for links in (False, True):
        weights = [weigh(x, links) for x in lines]
        blocks = [sum(weights[k] for k in range(i, min(i + 3, len(lines)))) for i in range(len(lines))]
        if any(blocks):
            break
    else:
        return []
    found, i = [], 0
    while i < len(lines):
        if not weights[i]:
            i += 1
            continue
        end = i
        while end < len(lines) and blocks[end]:
            end += 1
        if max(blocks[i:end]) >= min(40, max(blocks)):
            found.append((i, max(k for k in range(i, end) if weights[k]) + 1))
        i = end
    return found


def test_stretches_by_brute_force():
    rng = random.Random(2)
    for _ in range(400):
        lines = []
        for _ in range(rng.randrange(0, 40)):
            n = rng.choice([0, 0, 0, 1, 4, 12, 39, 40, 90])
            lines.append(("x" * n, rng.choice([0, 0, n // 2, n]), 0, ()))
        assert html_text.stretches(lines) == plain_stretches(lines), lines


PAGES = [
    # (page, what is left): stray blocks that no tag or name gives away stand before, between and after the text.
    ("<body><div>21 degrees</div><div><p>{0}</p><p>{1}</p></div><div>Back to top</div></body>", "{0}\n{1}"),
    ("<body><div>Mo Tu We</div><section><h2>Part</h2><p>{0}</p></section><section><p>{1}</p></section><div>3 items</div></body>", "Part\n{0}\n{1}"),
    ("<div><div><b>Log in</b></div><div><div><p>{0}</p></div><div><p>{1}</p><p>short</p></div></div><div>v 1.2</div></div>", "{0}\n{1}\nshort"),
]


@pytest.mark.parametrize("template,want", PAGES)
def test_blocks_tell_text_from_strays(template, want, monkeypatch):
    parts = prose(21, 60), prose(22, 50)
    page = template.format(*parts)
    assert html_text.main_text(page) == want.format(*parts)
    # Without the blocks every line is text, and the strays come along.
    monkeypatch.setattr(html_text, "stretches", lambda lines: [(0, len(lines))] if lines else [])
    assert html_text.main_text(page) != want.format(*parts)
