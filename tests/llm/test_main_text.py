"""Layouts of pages that the test tables don't hold."""

from tallyforge.llm import op08_html as op08

TEXT = "The way of the world is that it was and will be for all of us. " * 4


def test_article_inside_main():
    body = f"<h1>Title</h1><p>{TEXT}</p><p>Short.</p>"
    whole = f"Title\n{TEXT.strip()}\nShort."
    nav = "<nav><a href=/>Home</a></nav>"
    assert op08.main_text(f"{nav}<main><article>{body}</article></main>") == whole
    assert op08.main_text(f"{nav}<main><div><article>{body}<article><p>A comment on it, as is the way of all of them</p></article></article></div></main>") == whole
    assert op08.main_text(f"{nav}<main><article>{body}</article><aside><article><p>{TEXT}</p></article></aside></main>") == whole
    assert op08.main_text(f"{nav}<main><article>{body}</article><article><p>{TEXT}</p></article></main>") == f"{whole}\n{TEXT.strip()}"
    assert op08.main_text(f"{nav}<main><article>{body}</article><article class=comment><p>{TEXT}</p></article></main>") == whole
    assert op08.main_text(f"{nav}<main><article>{body}</article><p>{TEXT}</p></main>") == f"{whole}\n{TEXT.strip()}"


def test_pages_without_article_or_main():
    nav, foot = "<nav><a href=/>Home</a></nav>", "<footer>The owner of it all</footer>"
    whole = f"Title\n{TEXT.strip()}\nThe end."
    assert op08.main_text(f"<body>{nav}<div><h1>Title</h1><p>{TEXT}</p><p>The end.</p></div>{foot}") == whole
    assert op08.main_text(f"<body>{nav}<div><h1>Title</h1><p>{TEXT}</p><p>The end.</p></div><div class=promo>Buy</div><p>Small print</p><ul><li><a href=x>more</a></ul>{foot}") == whole
    assert op08.main_text(f"<body>{nav}<p>One line.</p>{foot}") == "One line."


def test_pages_of_few_stop_words():
    nav, foot = "<nav><a href=/>Home</a></nav>", "<footer>The owner of it all</footer>"
    russian, code = ("Сегодня утром жители города увидели первый снег, и дети вышли играть во двор. " * 4).strip(), "x = f(y); " * 12 + "end"
    assert op08.main_text(f"<body>{nav}<div><h1>Снег</h1><p>{russian}</p><pre>{code}</pre><p>Конец.</p></div>{foot}") == f"Снег\n{russian}\n{code}\nКонец."
    assert op08.main_text(f"<body>{nav}<div><p>{russian}</p><p>{TEXT}</p><pre>{code}</pre></div>{foot}") == f"{russian}\n{TEXT.strip()}\n{code}"
    assert op08.main_text(f"<body>{nav}<div class=sidebar><p>{russian}</p></div>{foot}") == ""


def test_pages_of_scripts_without_spaces():
    nav, foot = "<nav><a href=/>首页</a></nav>", "<footer>版权所有</footer>"
    prose = "今天早上城里的居民看到了第一场雪，孩子们跑到院子里玩耍，大人们站在窗边看着白色的街道。" * 3
    assert op08.main_text(f"<body>{nav}<div><h1>初雪</h1><p>{prose}</p><p>完。</p></div>{foot}") == f"初雪\n{prose}\n完。"
    assert op08.main_text(f"<body>{nav}<article><h1>初雪</h1><p>{prose}</p></article>{foot}") == f"初雪\n{prose}"


def test_names_mark_only_what_they_mean():
    for name in ("content no-sidebar", "has-sidebar", "ad-free", "noSidebar", "commented-code", "content-without-ads", "shared-story"):
        assert op08.main_text(f'<div class="{name}"><p>{TEXT}</p></div>') == TEXT.strip(), name
    for name in ("sidebar", "site-footer", "sidebar-left", "siteFooter", "ad", "box ad-1", "comment-list", "related-posts related", "cookie-banner", "widget", "share-buttons share"):
        assert op08.main_text(f'<div><p>{TEXT}</p></div><div class="{name}"><p>{TEXT}</p></div>') == TEXT.strip(), name


def test_stop_words_decide_on_links_in_articles(monkeypatch):
    prose, names = "the story of the man who was in the house by the sea and of all that he did for it", "Lorem Ipsum Dolor Amet Consectetur Adipiscing Elit Sed Eiusmod Tempor Incididunt"
    page = f"<article><h1><a href=/x>Title</a></h1><p>{TEXT}</p><div><a href=a>{prose}</a></div><ul><li><a href=b>{names}</a></ul><p>{TEXT}</p></article>"
    assert op08.main_text(page) == f"Title\n{TEXT.strip()}\n{prose}\n{TEXT.strip()}"
    monkeypatch.setattr(op08, "STOP_WORDS", frozenset(names.lower().split()))
    assert names in op08.main_text(page) and prose not in op08.main_text(page)


def test_pages_of_unmarked_blocks():
    menu = "".join(f"<div><a href=/{x}>{x}</a></div>" for x in ("Home", "News", "Sport"))
    tags = "Tags: " + ", ".join(f"<a href=/{k}>Topic number{k}</a>" if k % 3 == 0 else f"word{k}" for k in range(20))
    page = f"<body>{menu}<div>{TEXT}</div><div>A short one.</div><div>{TEXT}</div><div>{tags}</div>{menu}</body>"
    assert op08.main_text(page) == f"{TEXT.strip()}\nA short one.\n{TEXT.strip()}"
    assert op08.main_text(f'<div>{menu}</div><div role="main"><h2>Title</h2><p>{TEXT}</p></div><p>{TEXT}</p>') == f"Title\n{TEXT.strip()}"
