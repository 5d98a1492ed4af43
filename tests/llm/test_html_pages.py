"""Hand-labelled pages: what a reader would call the article, and what not."""

import pytest

from lodestone.llm.html_text import content_blocks

PROSE = [f"Sentence {k} of the article tells what happened, when it did, and why; readers may go on. It is long enough, surely." for k in range(6)]
P = "".join(f"<p>{t}</p>" for t in PROSE)
MENU = "<nav><a href=/>Home</a></nav><ul class=menu><li><a href=/a>News</a></ul>"
FOOT = "<footer>Imprint, contact.</footer>"
CARD = "<article class=card><h3>Other</h3><p>Read this too, it is good.</p></article>"

#: html, blocks that must be there, texts that must not.
PAGES = {
    "a form around the page": (f'<body>{MENU}<form id="aspnetForm" method=post><div><h1>T</h1>{P}</div><div class=sidebar><p>Side, of course.</p></div></form>{FOOT}', ["T", *PROSE], ["Side, of course.", "Home"]),
    "the word hidden in a value": (f'<body><article data-title="a hidden gem">{P}</article>', PROSE, []),
    "the word hidden in a title": (f'<body><div title="the hidden truth">{P}</div>{FOOT}', PROSE, ["Imprint, contact."]),
    "a hidden element": (f"<body><div>{P}</div><div hidden><p>Not shown, ever.</p></div><div HIDDEN=''><p>Nor this, at all.</p></div>", PROSE, ["Not shown, ever.", "Nor this, at all."]),
    "teasers in articles": (f'<body>{MENU}<div id="content"><h1>T</h1>{P}</div>{CARD * 4}', PROSE, ["Read this too, it is good."]),
    "a reader comment in an article": (f"<body><div id=text>{P}</div><article><p>I liked it, really. Thanks!</p></article>", PROSE, ["I liked it, really. Thanks!"]),
    "a reader comment after an article": (f"<body><article>{P}</article><article><p>I liked it, really. Thanks!</p></article>", PROSE, ["I liked it, really. Thanks!"]),
    "ids made from headings": (
        f'<body><article>{P}<h2 id="related-work">Related work</h2><p>Others, too, did it.</p><h2 id="comments-on-the-law">On the law</h2><section id="search-methods"><p>We search, then look.</p></section></article>',
        [*PROSE, "Related work", "Others, too, did it.", "On the law", "We search, then look."], [],
    ),
    "ids of boilerplate": (f'<body><article>{P}<div id="comments"><p>Nice one, thanks.</p></div><div id="share-box"><p>Share it, please.</p></div></article>', PROSE, ["Nice one, thanks.", "Share it, please."]),
    "feedback under the text": (f"<body><div class=text>{P}</div><div class=feedback><p>I disagree, sorry. It is not so.</p></div>", PROSE, ["I disagree, sorry. It is not so."]),
    "articles of like size": (f"<body><article>{P}</article><article>{P}</article>", [*PROSE, *PROSE], []),
    "a form under the text": (f"<body><main>{P}<form><p>Your name, please.</p><label>Mail</label></form></main>", PROSE, ["Your name, please.", "Mail"]),
}


@pytest.mark.parametrize("name", PAGES)
def test_page(name):
    html, wanted, unwanted = PAGES[name]
    got = content_blocks(html)
    assert [b for b in got if b in wanted] == wanted
    assert not set(got) & set(unwanted)


def test_precision_and_recall_over_all_pages():
    right = found = wanted = 0
    for html, want, _ in PAGES.values():
        got = content_blocks(html)
        right += sum(len(b) for b in got if b in want)
        found += sum(map(len, got))
        wanted += sum(map(len, want))
    assert right / found > 0.98 and right / wanted == 1
