"""Pages: text inside and around skipped elements, content regions, and time."""

import random
import time

import pytest

from regionflow.llm import html_text

PROSE = "".join(f"<p>Paragraph {i} has a good many words of plain prose in it, more than any menu.</p>" for i in range(2))
STORY = "".join(f"<p>Story paragraph {i} with a lot of words that tell the story at some length here.</p>" for i in range(6))


@pytest.mark.parametrize("tag", ["script", "svg", "button", "noscript", "iframe", "select", "textarea", "canvas", "object", "template", "video"])
def test_skipped_elements_inside_a_block(tag):
    inner = "" if tag in ("script", "iframe", "textarea") else "<b class='x'>no</b><div><p>text</p></div>"
    for around in ("<p>Before it <{0} id=a>{1}</{0}> after it</p>", "Before it <{0}>{1}</{0}> after it", "<p>Before <b>it <{0}>{1}</{0}></b> after it</p>"):
        got = html_text.main_text(f"<html><body><div>{PROSE}{around.format(tag, inner)}</div></body></html>").split("\n\n")
        assert got[-1] == "Before it after it" and len(got) == 3


def test_an_icon_s_own_elements():
    got = html_text.main_text(f"<body><div>{PROSE}<p>Before <svg viewBox='0 0 1 1'><path d='M0'/><g><use href='#a'/></g></svg> after.</p><p>Next <svg/> one.</p></div>")
    assert got.split("\n\n")[-2:] == ["Before after.", "Next one."]
    # one that never ends goes with the block around it
    assert html_text.main_text(f"<body><div>{PROSE}<div>Kept <svg><path></div><p>And this.</p></div>").endswith("Kept\n\nAnd this.")


def test_pages_in_a_form():
    assert html_text.main_text(f"<body><form action=x><input name=a>{PROSE}</form>").count("Paragraph") == 2
    got = html_text.main_text(f"<body><div>{STORY}</div><form><label>Your mail</label><p>We write once a week.</p></form>")
    assert got.count("Story") == 6 and "mail" not in got and "week" not in got


def test_articles():
    assert html_text.main_text(f"<body><article>Teaser one.</article><div id=story>{STORY}</div>").count("Story") == 6
    both = html_text.main_text(f"<body><article>{STORY}</article><article>{PROSE}</article>")
    assert both.count("Story") == 6 and both.count("Paragraph") == 2
    assert "Outside" not in html_text.main_text(f"<body><p>Outside of it.</p><article>{STORY}</article>")


def test_marks_of_inline_elements_and_hidden_ones():
    page = f"""<body><div>{PROSE}<p>Alpha <span class="ad">BUY NOW</span> delta.</p><div style="color:red; display : none">secret</div><p style="display:block">shown</p>
      <div class="user-reviews"><p>great item</p></div><p>Has <span hidden>no</span><i style="visibility:hidden">no</i> end.</p></div>"""
    assert html_text.main_text(page).split("\n\n")[2:] == ["Alpha delta.", "shown", "Has end."]


@pytest.mark.parametrize("a,b", [("<dd><dl>", "<dt>x"), ("<td><table>", "<th>x"), ("<p>", "<li>x"), ("<svg>", "<p>x</b>"), ("<article>", "</span><b class=x>y")])
def test_hostile_pages_are_linear(a, b):
    began = time.time()
    html_text.main_text(a + "<div>" * 30_000 + b * 30_000)
    assert time.time() - began < 15


INLINE, BLOCKS, QUIET, DULL = ["b", "span class=x", "a href=u", "em"], ["div", "section", "blockquote", "ul class=y"], ["script", "svg", "button", "noscript", "select"], ["nav", "aside", "div class=sidebar", "span class=ad", "p hidden"]


def page_of(rng, depth=0):
    """HTML of random nodes."""
    out = []
    for _ in range(rng.randint(1, 5)):
        kind = rng.random()
        if kind < 0.45 or depth > 5:
            out.append((None, f"w{rng.randint(0, 99)} "))
        else:
            tag = rng.choice(INLINE if kind < 0.6 else BLOCKS if kind < 0.8 else QUIET if kind < 0.9 else DULL)
            if tag == "script":
                out.append((tag, [(None, "var x = 1; ")]))
            elif tag == "p hidden":
                out.append((tag, [(None, "hidden words ")]))
            else:
                out.append((tag, page_of(rng, depth + 1)))
    return out


def written(nodes):
    return "".join(x if tag is None else f"<{tag}>{written(x)}</{tag.split()[0]}>" for tag, x in nodes)


def read(nodes, lines, quiet=False, dull=False):
    """Lines by walking the tree: a block breaks, what is quiet or dull has no text."""
    for tag, x in nodes:
        name = (tag or "").split(" ")[0]
        if tag is None:
            if not quiet and not dull:
                lines[-1].append(x)
            continue
        breaks = not quiet and name in html_text.BLOCK
        if breaks:
            lines.append([])
        read(x, lines, quiet or tag in QUIET, dull or tag in DULL)
        if breaks:
            lines.append([])
    return lines


@pytest.mark.parametrize("seed", range(3))
def test_blocks_against_a_walk_of_the_tree(seed):
    rng = random.Random(seed)
    some = 0
    for _ in range(400):
        nodes = page_of(rng)
        p = html_text.Lines()
        p.feed(f"<body>{written(nodes)}</body>")
        p.close()
        p.flush()
        # by their names and nature alone, whatever share of the page they hold
        dull = p.inside([m != html_text.NONE for m in p.mark])
        got = [" ".join("".join(t for t, e in pieces if not dull[e]).split()) for pieces, _ in p.lines]
        want = [" ".join("".join(x).split()) for x in read(nodes, [[]])]
        assert [x for x in got if x] == [x for x in want if x]
        some += len(got)
    assert some > 500
