"""The small labelled table: blocks of hand-made page layouts, each marked as main text (1) or not (0)."""

from __future__ import annotations

from .html_blocks import blocks, features


def _w(n: int) -> str:
    return " ".join(["word"] * n)


def _a(n: int) -> str:
    return f'<a href="/x">{_w(n)}</a>'


def _p(n: int, label: int) -> tuple[str, int]:
    return f"<p>{_w(n)}</p>", label


def _list(n: int, words: int, label: int = 0) -> list:
    return ["<ul>", *[(f"<li>{_a(words)}</li>", label) for _ in range(n)], "</ul>"]


#: Pages as lists of markup without text and (markup of one block, label).
PAGES: list[list] = [
    ["<nav>", *_list(6, 1), "</nav>", (f'<div class="ad">{_w(9)}</div>', 0), "<article>", (f"<h1>{_w(7)}</h1>", 1),
     _p(1, 1), _p(60, 1), _p(2, 1), (f"<p>{_w(30)} {_a(2)} {_w(4)}</p>", 1), _p(150, 1), _p(1, 1), "</article>",
     "<footer>", (f"<p>{_w(8)} {_a(1)}</p>", 0), (f"<div>{_w(40)}</div>", 0), "</footer>"],
    ["<header>", (f"<div>{_w(2)}</div>", 0), _p(14, 0), "</header>", '<div id="content">', (f"<h2>{_w(5)}</h2>", 1), _p(40, 1),
     _p(4, 1), _p(90, 1), '<div class="share">', (f"<span>{_w(3)}</span>", 0), "</div>", "</div>", '<div class="sidebar">',
     _p(35, 0), *_list(5, 6), "</div>", '<div class="cookie-notice">', _p(28, 0), (f"<button>{_w(1)}</button>", 0), "</div>"],
    ["<table><tr><td>", *[(f"<div>{_a(2)}</div>", 0) for _ in range(4)], "</td><td>", _p(80, 1), _p(12, 1), _p(70, 1),
     _p(45, 1), "</td></tr><tr><td>", (f"<div>{_a(2)} {_a(2)} {_w(2)}</div>", 0), "</td></tr></table>"],
    ["<main>", "<header>", (f"<h1>{_w(9)}</h1>", 1), _p(5, 0), "</header>", _p(25, 1), _p(100, 1), (f"<h2>{_w(3)}</h2>", 1),
     _p(8, 1), '<form action="/s">', (f"<label>{_w(6)}</label>", 0), _p(20, 0), "</form>", _p(55, 1), '<section class="related">',
     (f"<h3>{_w(2)}</h3>", 0), *_list(4, 8), _p(30, 0), "</section>", "</main>", '<div role="contentinfo">', _p(20, 0), "</div>"],
    [(f"<div>{_a(1)} {_a(1)} {_a(1)} {_a(1)}</div>", 0), (f"<div>{_a(2)} {_w(1)} {_a(2)}</div>", 0), (f"<div>{_w(65)}</div>", 1),
     (f"<div>{_w(9)}</div>", 1), (f"<div>{_w(120)}</div>", 1), (f"<div>{_w(30)}</div>", 1), (f"<div>{_w(4)} {_a(3)}</div>", 0)],
    ["<article>", (f"<h1>{_w(4)}</h1>", 1), "<ul>", (f"<li>{_w(12)}</li>", 1), (f"<li>{_w(3)}</li>", 1), (f"<li>{_w(1)}</li>", 1),
     "</ul>", (f"<blockquote>{_w(22)}</blockquote>", 1), (f"<pre>{_w(10)}</pre>", 1), "<aside>", (f"<p>{_w(50)}</p>", 0), "</aside>",
     (f"<p>{_a(8)}</p>", 1), _p(16, 1), '<div class="comments">', (f"<h3>{_w(2)}</h3>", 0), "<ol>",
     (f"<li>{_w(45)}</li>", 0), (f"<li>{_w(5)}</li>", 0), "</ol>", "</div>", "</article>"],
    ['<div role="dialog">', _p(60, 0), "</div>", "<header>", "<nav>", *_list(3, 2), "</nav>", (f"<div>{_w(5)}</div>", 0), "</header>",
     "<main>", "<section>", (f"<h2>{_w(6)}</h2>", 1), _p(33, 1), "</section>", '<div class="ad-slot">', _p(18, 0), "</div>",
     "<section>", _p(3, 1), _p(75, 1), "</section>", "</main>", "<aside>", _p(90, 0), (f"<div>{_w(2)}</div>", 0), "</aside>",
     (f"<div>{_w(30)}</div>", 0), (f"<div>{_w(3)}</div>", 0)],
    ['<div class="post">', _p(28, 1), _p(2, 1), _p(64, 1), "</div>", '<div id="comments">', _p(70, 0), _p(3, 0), "</div>",
     (f"<p>{_w(6)} {_a(4)}</p>", 0)],
    [_p(40, 1), _p(11, 1), _p(52, 1)],
    [_p(18, 1)],
    ["<nav>", (f"<div>{_w(40)}</div>", 0), "</nav>", "<article>", _p(6, 1), "</article>", "<footer>", (f"<div>{_w(25)}</div>", 0), "</footer>"],
    ['<form id="page">', (f"<div>{_a(3)}</div>", 0), (f"<div>{_w(20)}</div>", 0), "<article>", (f"<h1>{_w(3)}</h1>", 1), _p(31, 1),
     _p(1, 1), "</article>", "</form>", (f"<div>{_w(50)}</div>", 0)],
    ["<header>", (f"<h1>{_w(2)}</h1>", 0), "</header>", '<div class="entry">', (f"<h1>{_w(8)}</h1>", 1), _p(20, 1), _p(1, 1), _p(38, 1),
     *_list(2, 4), "</div>", "<footer>", (f"<h4>{_w(2)}</h4>", 0), *_list(3, 2), "</footer>"],
    ["<nav>", *_list(4, 1), "</nav>", "<article>", (f"<h1>{_w(1)}</h1>", 1), _p(1, 1), _p(2, 1), _p(1, 1), _p(3, 1), _p(5, 1), _p(1, 1)],
    ["<main>", _p(3, 1), _p(200, 1), _p(2, 1), _p(4, 1), _p(200, 1), _p(7, 1), _p(1, 1), "</main>", (f"<div>{_w(3)}</div>", 0),
     (f"<div>{_w(60)}</div>", 0)],
    [(f"<div>{_w(3)}</div>", 0), (f"<div>{_w(45)}</div>", 0), "<article>", (f"<h2>{_w(12)}</h2>", 1), _p(200, 1), _p(1, 1),
     (f"<p>{_a(1)}</p>", 1), (f"<p>{_a(3)} {_w(2)}</p>", 1), _p(10, 1), (f"<li>{_a(5)}</li>", 1), "</article>"],
    [(f"<div>{_w(2)}</div>", 0), (f"<div>{_a(1)} {_a(1)} {_a(1)}</div>", 0), _p(60, 1), _p(3, 1), _p(45, 1), (f"<div>{_w(4)}</div>", 0)],
    [(f"<div>{_w(3)}</div>", 0), _p(70, 1), _p(2, 1), _p(50, 1), _p(4, 1), _p(33, 1), (f"<div>{_w(5)}</div>", 0), (f"<div>{_a(3)}</div>", 0)],
]


def labelled_table() -> tuple[list[list[float]], list[int]]:
    """Feature rows and labels of all blocks."""
    rows, labels = [], []
    for page in PAGES:
        want = [p[1] for p in page if isinstance(p, tuple)]
        got = blocks("<body>" + "".join(p if isinstance(p, str) else p[0] for p in page) + "</body>")
        if len(got) != len(want):
            raise ValueError("a labelled page has another number of blocks than labels")
        rows += features(got)
        labels += want
    return rows, labels
