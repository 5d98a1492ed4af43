"""Short blocks of an article stay."""

from lodestone.llm import html_text

LONG = "".join(f"<p>{'word ' * 98}a, b, c; d: e. f! g?</p>" for _ in range(8))
SHORT = "<ul><li>first item<li>second item</ul><table><tr><td>1</td><td>2</td></tr></table><pre>x = 1</pre>"


def test_lists_and_tables_of_an_article_stay():
    page = f'<body><nav>Menu</nav><article><h1>T</h1>{LONG}{SHORT}<div class="comments"><p>Nice</p></div></article><div>Elsewhere</div>'
    blocks = html_text.content_blocks(page)
    assert blocks[0] == "T" and blocks[-5:] == ["first item", "second item", "1", "2", "x = 1"] and len(blocks) == 14


def test_without_article():
    links = "<ul><li><a href=1>Home</a><li><a href=2>News</a></ul>"
    end = ["first item", "second item", "1", "2", "x = 1"]
    assert html_text.content_blocks(f"<body>{links}<div>{LONG}{SHORT}</div>")[-5:] == end
    assert html_text.content_blocks(f"<body>{links}{LONG}{SHORT}<p>{'word ' * 90}end.</p>")[-6:-1] == end
    assert "Home" not in html_text.content_blocks(f"<body>{links}<div>{LONG}{SHORT}</div>")
