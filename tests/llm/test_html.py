"""Main text of made pages whose article is known, of odd names and of deep markup."""

import random
import time

import pytest

from newsgraph.llm import html_text

REMARK = "A long remark of a reader that goes on and on, with many words and hardly a tag in all of it, so that it looks like prose. " * 3
STORY = "The story of the day goes on with words and more words of prose, line after line. " * 4
REMARK, STORY = REMARK.strip(), STORY.strip()
BODY = f"<p>{STORY}</p>"


@pytest.mark.parametrize("mark", ["class='comment-thread'", "class='user-comments-list'", "id='disqus_thread'", "class=comments", "class='comment'", "class='reader-remarks'", "id=respond"])
def test_reader_comments_go_however_long(mark):
    assert html_text.main_text(f"<main><h1>T</h1>{BODY}{BODY}<div {mark}><p>{REMARK}</p></div></main>") == f"T\n{STORY}\n{STORY}"


@pytest.mark.parametrize("mark", ["p class=teaser", "p class=comment", "div class=widget", "section class=has-comments", "div class=post-header", "blockquote class=comment"])
def test_names_are_evidence_only(mark):
    end = mark.split()[0]
    assert html_text.main_text(f"<article><h1>T</h1>{BODY}<{mark}>{REMARK}</{end}>{BODY}</article>") == f"T\n{STORY}\n{REMARK}\n{STORY}"
    assert html_text.main_text(f"<body><div class=has-sidebar>{BODY}{BODY}</div><div class=sidebar>S</div></body>") == f"{STORY}\n{STORY}"
    assert html_text.main_text("<body><div class=ad>Buy this now</div></body>") == ""


def test_what_stands_around_prose_outside_the_article_goes():
    """A remark beside the article widens the region to the body, and nothing else comes with it."""
    around = "<ul><li><a href=1>Home</a><li><a href=2>News</a></ul>"
    notice = "<div>Join our newsletter</div>"
    assert html_text.main_text(f"<body>{around}<article><h1>T</h1>{BODY}{BODY}</article>{notice}<div class=x><p>{REMARK}</div></body>") == f"T\n{STORY}\n{STORY}"
    assert html_text.main_text(f"<body>{around}<div><h1>T</h1>{BODY}{BODY}</div>{notice}<div class=x><p>{REMARK}</div></body>") == f"T\n{STORY}\n{STORY}\n{REMARK}"


def test_links_count_at_any_depth():
    deep = "<span><b><i><em><u><s><small>"
    menu = "".join(f"<li><a href={i}>{deep}entry {i} of the menu with a name as long as that of a sentence{deep.replace('<', '</')}</a>" for i in range(8))
    assert html_text.main_text(f"<body><div><ul>{menu}</ul></div><div><h1>T</h1>{BODY}{BODY}</div></body>") == f"T\n{STORY}\n{STORY}"


def test_parts_of_an_article_stay():
    inner = "<ul><li>one<li>two</ul>"
    table = "<table><tr><td>1<td>2<tr><td>3</table>"
    want = f"T\n{STORY}\none\ntwo\n{STORY}\n1\n2\n3"
    for around in ("div", "article", "section"):
        assert html_text.main_text(f"<body><{around}><h1><a href=/>T</a></h1>{BODY}{inner}{BODY}{table}</{around}></body>") == want
    links = "<ul><li><a href=1>Other one</a><li><a href=2>Other two</a></ul>"
    assert html_text.main_text(f"<article><h1>T</h1>{BODY}{links}{BODY}{links}</article>") == f"T\n{STORY}\nOther one\nOther two\n{STORY}"


@pytest.mark.parametrize("page", ["".join(f"<div>{i} " for i in range(20_000)), "<b>" * 20_000 + "<p>x" * 20_000, "<table>" + "<tr><td>x" * 20_000, "<ul>" + "<li><ul><li>x" * 10_000, "<a>" * 20_000 + "<li>x" * 20_000])
def test_deep_markup_takes_linear_time(page):
    before = time.process_time()
    assert html_text.main_text(page)
    assert time.process_time() - before < 2


def test_made_pages_with_a_known_article():
    """Pages put together from parts of known kind: the text is that of the parts of the article."""
    r = random.Random(3)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randint(3, 9)))
    some = lambda n: " ".join(word() for _ in range(n))

    def item() -> str:
        return f"<li><a href='/{word()}'><span>{some(r.randint(1, 3))}</span></a></li>"

    beside = [
        lambda: f"<nav><ul>{item()}{item()}{item()}</ul></nav>",
        lambda: f"<div class='{r.choice(['menu', 'site-nav', 'x1'])}'><ul>{''.join(item() for _ in range(r.randint(3, 9)))}</ul></div>",
        lambda: f"<div class='{r.choice(['ad', 'sidebar-left', 'cookie-notice', 'newsletter', 'share-buttons'])}'><p>{some(r.randint(3, 12))}</p></div>",
        lambda: f"<aside><p>{some(40)}</p></aside>",
        lambda: f"<form><label>{some(2)}</label><input><button>{word()}</button></form>",
        lambda: f"<script>{some(30)}</script><style>p{{}}</style>",
        lambda: f"<section class='{r.choice(['comments', 'comment-list', 'post-comments'])}'><h3>{some(2)}</h3><div><p>{some(60)}</p></div></section>",
        lambda: f"<footer><p>{some(9)}</p></footer>",
    ]
    for _ in range(400):
        lines, html = [some(6)], ""
        html = f"<h1>{lines[0]}</h1>"
        for i in range(r.randint(3, 8)):
            n = r.randint(40, 90)
            if i and r.random() < 0.2:
                two = [some(3), some(4)]
                html += f"<ul><li>{two[0]}<li>{two[1]}</ul>"
                lines += two
            words = some(n).split()
            k = r.randrange(n)
            html += "<p>" + " ".join([*words[:k], f"<a href=x><b>{words[k]}</b></a>", *words[k + 1 :]]) + "</p>"
            lines.append(" ".join(words))
            if r.random() < 0.2:
                html += beside[r.choice([2, 3, 5])]()
        around = r.choice(["article", "main", "div", "div id=content", "section class=post"])
        parts = [r.choice(beside)() for _ in range(r.randint(1, 4))]
        page = "<html><body>" + "".join(parts[:2]) + f"<{around}>{html}</{around.split()[0]}>" + "".join(parts[2:]) + "</body></html>"
        assert html_text.main_text(page) == "\n".join(lines), page
