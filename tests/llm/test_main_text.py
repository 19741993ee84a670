import random
import time

import pytest

from quern.llm import main_text as M

ARTICLE = "<h1>Title &amp; more</h1><p>First paragraph with <b>bold</b> words and\n a <a href='#'>link</a> in it.<p>Second one, unclosed.<ul><li>item one of some</li><li>item two of some</li></ul>"
WANT = "Title & more\nFirst paragraph with bold words and a link in it.\nSecond one, unclosed.\nitem one of some\nitem two of some"
JUNK = '<nav><ul><li><a href="/x">Home page</a></li></ul></nav><div class="ad">Buy this thing now please do</div><aside>Other words on the side</aside>'
FOOT = '<div id="comments"><p>First! What a fine article this is indeed</p></div><footer>&copy; someone and others too</footer><form><p>Enter your mail here</p></form><div class="cookie-notice">We use cookies for many things</div>'
PLAIN = M.weights({})


def words(n, seed="w"):
    return " ".join(f"{seed}{i}" for i in range(n))


@pytest.mark.parametrize("frame", ["<article>{}</article>", "<main>{}</main>", "<div>{}</div>", "<div class='post'>{}</div>", "<form><article>{}</article></form>", "<div class='no-sidebar'>{}</div>"])
def test_what_is_left_out(frame):
    page = f"<!DOCTYPE html><html><head><title>T</title><style>p{{x}}</style><script>var a = '</p>' < 3;</script></head><body><header>Site name</header>{JUNK}<!-- note -->{frame.format(ARTICLE)}{FOOT}</body></html>"
    assert M.extract(page, PLAIN) == WANT


@pytest.mark.parametrize("noise", ["<aside><p>an <b>advert</b> here</p></aside>", "<form><div><input><button>Go</button></div></form>", "<nav><ul><li>a</li></ul></nav><p class='ad'>buy<aside>more</aside>", "<div class='comments'><article>well said</article></div>", "<article class='related'>other news</article>", f"<aside>{'<a href=x>link</a>' * 60}</aside>", "<div class='header'>Part</div>"])
@pytest.mark.parametrize("frame", ["article", "main", "div"])
def test_noise_inside_an_article_does_not_cut_it(noise, frame):
    long = words(300)
    page = f"<body>{JUNK}<{frame}><p>A short lead.</p>{noise}<p>{long}</p>{noise}{noise}<p>Last words.</p></{frame}>{FOOT}</body>"
    assert M.extract(page, PLAIN) == f"A short lead.\n{long}\nLast words."


def test_tables_and_short_blocks_of_an_article_stay():
    rows = "".join(f"<tr><td>k{i}</td><td>{i}</td></tr>" for i in range(40))
    for frame in ("article", "div"):
        page = f"<body>{JUNK}<{frame}><p>{words(20)}</p><table>{rows}</table><p>{words(15, 'x')}</p></{frame}>{FOOT}</body>"
        assert M.extract(page, PLAIN).split("\n") == [words(20), *[x for i in range(40) for x in (f"k{i}", str(i))], words(15, "x")]


def test_marked_content_is_taken_before_a_longer_teaser():
    assert M.extract(f"<body><div>{words(50)}</div><article><p>{words(8, 'x')}</p></article><div>{words(90)}</div></body>", PLAIN) == words(8, "x")
    # Several articles mark nothing: the best one is taken, and not the short ones beside it.
    assert M.extract(f"<main><article>{words(20, 'a')}</article><article><p>{words(90)}</p></article><article>{words(20, 'b')}</article></main>", PLAIN) == words(90)


STORY = f"<h1>A heading</h1><p>{words(60)}</p><p>Last words.</p>"
TOLD = f"A heading\n{words(60)}\nLast words."
TOP = "<header>Site</header><nav><a href=x>Home</a> <a href=y>News of the day and more</a></nav>"


@pytest.mark.parametrize(
    "frame",
    [
        "<div class='content-sidebar-wrap'><main>{}</main><aside>By the way</aside></div>",
        "<div class='page-with-sidebar'><article>{}</article><div class='sidebar'>Links of the week</div></div>",
        "<div class='site header-fixed'><article>{}</article></div>",
        "<div class='header'><div><article>{}</article></div></div>",
        "<div class='story ad-free'>{}</div>",
        "<article class='post comments-open'>{}</article>",
        "<article class='post share-enabled'>{}</article>",
        "<div id='comments-wrapper'><article class='social'>{}</article></div>",
        "<form class='page-form' action='/'><div>{}</div></form>",
        "<div class='noSidebar has-nav'><div class='entry'>{}</div></div>",
        "<div class='widget-area'><main><div>{}</div></main></div>",
    ],
)
def test_what_holds_the_content_is_no_noise(frame):
    page = f"<body>{TOP}{frame.format(STORY)}<div class='site-footer'>Someone and others</div></body>"
    assert M.extract(page, PLAIN) == TOLD


@pytest.mark.parametrize("frame", ["<article>{}</article>", "<div>{}</div>"])
def test_names_of_several_words_within_an_article(frame):
    inner = "<div class='social-history'><p>The social history of the town.</p></div><div class='adBox'>Buy</div><div class='share-buttons'>Tell others</div><div id='ad-slot-3'>Now</div><p class='advertising-law'>On the law.</p>"
    page = f"<body>{TOP}{frame.format(STORY + inner)}</body>"
    assert M.extract(page, PLAIN) == TOLD + "\nThe social history of the town.\nOn the law."


def test_random_wrappers_keep_the_article():
    rng = random.Random(5)
    names = ["content-sidebar", "no-ads", "ad-free", "has-comments", "page-header-below", "social-feed", "story", "notice-board", "with-widget", "cookie-recipes", "main", "wrap"]
    for _ in range(300):
        body = f"<article>{STORY}</article>" if rng.random() < 0.5 else f"<div>{STORY}</div>"
        for _ in range(rng.randrange(1, 5)):
            body = f"<div class='{' '.join(rng.sample(names, rng.randrange(1, 3)))}'>{body}</div>"
        assert M.extract(f"<body>{TOP}{body}{FOOT}</body>", PLAIN) == TOLD, body


def test_scripts_without_blanks():
    text = "春天来了城里的人们都走出家门去看花" * 6
    for page in (f"<div><p>{text}。</p><p>{text}！</p></div><div><p>Copyright 2024 Example Company Limited All Rights Reserved</p></div>", f"<body>{TOP}<div><p>{text}。</p>\n<p>{text}！</p></div><footer>Copyright Example</footer></body>"):
        assert M.extract(page, PLAIN) == f"{text}。\n{text}！" or M.extract(page, PLAIN).startswith(f"{text}。\n{text}！")


def test_comments_longer_than_the_article_are_left_out():
    page = f"<body>{TOP}<div class='story'><h1>A heading</h1><p>{words(40)}</p></div><div id='comments'><p>{words(200, 'c')}</p></div></body>"
    assert M.extract(page, PLAIN) == f"A heading\n{words(40)}"


def test_noise_that_crosses_the_articles_end_ends_it():
    long = words(300)
    assert M.extract(f"<article><p>{long}</p><aside>side</article></aside><p>Not of it.</p>", PLAIN) == long


def test_truncated_and_broken_pages():
    assert M.extract("<p>Some words here &am", PLAIN) == "Some words here &am"
    assert M.extract("<p>Some words here &ampx <b", PLAIN) == "Some words here &x"
    assert M.extract("<p>a <nav>never closed words words", PLAIN) == "never closed words words"  # a menu is costlier to cross than one word gains
    assert M.extract("plain text only", PLAIN) == "plain text only"
    assert M.extract("<script>only('code')", PLAIN) == ""
    assert M.extract("a < b and c > d", PLAIN) == "a < b and c > d"
    assert M.extract("<p class=it's>one two</p><p title='it>s'>three <script>x</script>four</p>", PLAIN) == "one two\nthree four"
    assert M.extract(f"<p>{'İ' * 30}<SCRIPT>code</Script>words after it</p>", PLAIN) == "İ" * 30 + "words after it"


@pytest.mark.parametrize("part", ["<div class=ad>x", "<b>", "<i><p>x", "<span class=ad>", "<script>", "<a title='", '<a x="y> ', "</div>", "<table><tr><td>", "<!--", "<article>w", "<li>"])
def test_time_grows_with_the_page(part):
    page = part * (4_000_000 // len(part))
    start = time.process_time()
    M.extract(page, PLAIN)
    assert time.process_time() - start < 60


def test_region_against_all_runs():
    rng = random.Random(1)
    for _ in range(300):
        score = [rng.choice([-4.0, -1.0, -0.5, 0.0, 1.0, 2.0, 5.0]) for _ in range(rng.randrange(0, 30))]
        best, span = 0.0, (0, 0)
        for j in range(len(score)):
            for i in range(j, -1, -1):
                if sum(score[i : j + 1]) > best:
                    best, span = sum(score[i : j + 1]), (i, j + 1)
        lo, hi = M.best_region(score)
        assert sum(score[lo:hi]) == best and hi == span[1]


def test_learned_weights_follow_the_labels():
    pages = [f"<body class='wide'><div class='wide'><div class='blurb'><span>x</span></div><div><br></div><div class='say'><article><p class='say'>{'w ' * 9}</p><p>more</p></article></div></div></body>"] * 25
    tags, names = M.Counter(), M.Counter()
    for p in pages:
        a, b = M.label(p)
        tags, names = tags + a, names + b
    own = M.weights(dict(tags), dict(names))
    assert own.cost["div"] > own.cost["p"] == M.LEAST and own.cost["article"] == M.BORDER
    assert own.noise - M.NOISE == {"blurb"}
    page = f"<div><div class='blurb'>{words(5)}</div><p>{words(30, 'x')}</p></div>"
    assert M.extract(page, own) == words(30, "x") and words(5) in M.extract(page, PLAIN)


def test_table(spark):
    page = f"<html><body>{JUNK}<article>{ARTICLE}</article>{FOOT}</body></html>"
    rows = [(1, "u", page), (2, None, None), (3, "v", ""), (1, "u", page), (None, "w", "<p>words of text</p>"), (4, "l", "<article>" + "<p>" + "word " * 200_000 + "</p></article>")]
    pages = spark.createDataFrame([(*r, "t") for r in rows], "page_id bigint, url string, html string, text string")
    got = sorted((str(r.page_id), r.text, r.n_chars) for r in M.extract_pages(pages).collect())
    long = ("word " * 200_000).strip()
    assert got == sorted([("1", WANT, len(WANT)), ("1", WANT, len(WANT)), ("2", "", 0), ("3", "", 0), ("None", "words of text", 13), ("4", long, len(long))])
    assert M.extract_pages(pages.limit(0)).count() == 0


def test_given_pages(spark):
    import html
    import re

    from ..compare import DATA

    pages = spark.read.parquet(f"{DATA}/pages.parquet")
    got = {r.page_id: r.text for r in M.extract_pages(pages).collect()}
    for r in pages.collect():
        inner = re.search("<article>(.*)</article>", r.html, re.S)[1]
        blocks = (re.sub(r"\s+", " ", html.unescape(re.sub("</?b>", "", x))).strip() for x in re.split("</?(?:p|h1|br)>", inner))
        assert got[r.page_id] == "\n".join(b for b in blocks if b)
