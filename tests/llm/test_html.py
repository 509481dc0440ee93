"""Templates inside articles, wrappers that take the main text, and page heads."""

import pytest

from maskwright.llm import op1_html


def extracted(spark, pages):
    rows = [(i, url, html) for i, (url, html) in enumerate(pages)]
    got = {r.page_id: r.text for r in op1_html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    return [got[i] for i in range(len(rows))]


def test_boilerplate_inside_a_mark_goes_and_copies_stay(spark):
    box = "<div><p>By the staff</p><p>Read also: things</p></div>"
    page = lambda own, mark="main": f"<html><body><div>Shop</div><{mark}><h1>{own}</h1><p>Text of {own}</p>{box}</{mark}><div>All about us</div></body></html>"
    pages = [(f"http://a.org/{i}", page(f"story {i}", "article")) for i in range(6)] + [(f"http://b.org/{i}", page(f"story {i}")) for i in range(6)]
    # copies of one article, beside few others, are no template
    pages += [(f"http://c.org/{i}", page("copied")) for i in range(6)] + [("http://c.org/x", page("other"))]
    # an article is never taken whole
    pages += [("http://a.org/only", f"<html><body><div>Shop</div><article>{box}</article><div>All about us</div></body></html>")]
    got = extracted(spark, pages)
    assert got[:12] == [f"story {i}\nText of story {i}" for i in range(6)] * 2
    both = "\nBy the staff\nRead also: things"
    assert got[12:19] == ["copied\nText of copied" + both] * 6 + ["other\nText of other" + both]
    assert got[19] == both[1:]


BODY = "<h1>Title</h1><p>A long enough text of the article.</p><p>And its end.</p>"
TEXT = "Title\nA long enough text of the article.\nAnd its end."
NAV, COMMENTS = "<nav><a href=x>Home</a></nav>", "<div class='comments'><p>me too, " + "and so on " * 40 + "</p></div>"


@pytest.mark.parametrize("html, text", [
    (f"<body>{NAV}<div class='content has-sidebar'><article>{BODY}</article></div>", TEXT),
    (f"<body>{NAV}<div class='site no-comments'><div>{BODY}</div><div class=sidebar>Other</div></div>", TEXT),
    (f"<body>{NAV}<div class='right-sidebar layout'><article>{BODY}</article><div class=right-sidebar>Other</div></div>", TEXT),
    (f"<body>{NAV}<div class='right-sidebar layout'><div>{BODY}</div></div>", TEXT),
    (f"<body>{NAV}<div class='right-sidebar layout'><main>{BODY}</main></div><div><article>Teaser</article></div>", TEXT + "\nTeaser"),
    (f"<body><form action=x>{NAV}<div>{BODY}</div><footer>All about us</footer></form>", TEXT),
    (f"<body><form action=x>{NAV}<article>{BODY}</article></form>", TEXT),
    (f"<html><head><meta charset=utf-8><title>T</title><body>{NAV}<article>{BODY}</article>", TEXT),
    (f"<head><title>T</title><style>p{{}}</style><div>{BODY}</div>", TEXT),
    # what is no wrapper stays left out
    (f"<body><div>{BODY}</div>{COMMENTS}<div class='post-sidebar'>Other</div><form><p>mail</p></form>", TEXT),
    (f"<body><article>{BODY}</article><div id=comments><article class=comment-body>me too</article></div>", TEXT),
    (f"<body><div>{BODY}</div><div id=comments><article class=comment-body>me too</article></div>", TEXT),
    (f"<body><article>{BODY}</article><div class=related><article>Teaser</article></div>", TEXT),
    ("<body><p>Sh is.</p>" + COMMENTS, "Sh is."),
    ("<body><p>Sh is.</p><div class='top-menu'>" + "<a href=x>one of the links</a> " * 30 + "</div>", "Sh is."),
])
def test_wrappers_and_heads(html, text):
    assert op1_html.main_text(html) == text


def test_repeated_rows_do_not_cancel_out(spark):
    # each row twice: the two notes are on different pages, so they are no class
    page = lambda i: f"<body><div>Shop</div><div>Story {i}</div>{'<p>Note A</p>' if i < 4 else ''}{'<p>Note B</p>' if i > 1 else ''}<div>All about us</div></body>"
    got = extracted(spark, [(f"http://d.org/{i // 2}", page(i // 2)) for i in range(12)])
    assert got == ["\n".join([f"Story {i // 2}"] + ["Note A"] * (i < 8) + ["Note B"] * (i > 3)) for i in range(12)]


def test_near_copies_keep_what_they_share(spark):
    page = lambda i: f"<body><div>Shop</div><article>{BODY}<p>Edition {i}</p></article><div>All about us</div></body>"
    assert extracted(spark, [(f"http://e.org/{i}", page(i)) for i in range(6)]) == [f"{TEXT}\nEdition {i}" for i in range(6)]


def test_classes_nest_and_gaps_are_slots():
    """Tokens 1 to 4 are a class with a gap each; 10 and 11 one inside its second gap, once or several times."""
    t = op1_html.Template([(False, (1, 2, 3, 4)), (False, (10, 11))])
    nest = lambda *tokens: t.nest([(False, x) for x in tokens])
    right, around = nest(1, 50, 2, 10, 51, 11, 10, 52, 11, 53, 3, 4, 54)
    assert right == [True, False, True, True, False, True, True, False, True, False, True, True, False]
    assert [around[i] for i in (1, 4, 7, 9, 12)] == [((0, 1),), ((0, 2), (1, 1)), ((0, 2), (1, 1)), ((0, 2),), ()]
    # a token out of order is at no place; a class that goes on ends what is open inside it
    assert nest(1, 3, 2)[0] == [True, False, True] and nest(2, 11)[0] == [False, False]
    right, around = nest(1, 10, 2, 11, 3, 4)
    assert right == [True, True, True, False, True, True] and around[3] == ((0, 2),)
    assert nest(1, 1, 2)[0] == [True, True, True] and op1_html.Template().nest([(True, 1)]) == ([False], [()])


def test_a_sentence_like_boilerplate_stays_where_it_is_none(spark):
    """Inside an article only a token at its place in its class is cut."""
    head, foot = "<p>By the staff</p>", "<p>Read also: things</p>"
    page = lambda i, extra="": f"<html><body><div>Shop</div><article>{head}<h1>Story {i}</h1><p>Text {i}</p>{extra}<p>More {i}</p>{foot}</article><div>About</div></body></html>"
    got = extracted(spark, [(f"http://n.org/{i}", page(i)) for i in range(6)])
    assert got == [f"Story {i}\nText {i}\nMore {i}" for i in range(6)]


def test_any_host_finds_its_template(spark):
    page = lambda i: f"<body><div>Shop</div><div>Story {i}</div><div>All about us</div></body>"
    for host in ("//h.org", "http://[2001:db8::1]", "http://user@H.org:80", "https://h.org?x"):
        assert extracted(spark, [(f"{host}/{i}", page(i)) for i in range(6)]) == [f"Story {i}" for i in range(6)]


def test_many_hosts_meet_their_templates_with_salt(spark, monkeypatch):
    monkeypatch.setattr(op1_html, "BROADCAST_ROWS", 0)
    page = lambda h, i: f"<body><div>Shop {h}</div><div>Story {i}</div><div>All about {h}</div></body>"
    rows = [(f"http://h{h}.org/{i}", page(h, i)) for h in range(3) for i in range(6)] + [(None, page(9, 9)), ("http://alone.org", page(8, 8))]
    assert extracted(spark, rows) == [f"Story {i}" for h in range(3) for i in range(6)] + ["Shop 9\nStory 9\nAll about 9", "Shop 8\nStory 8\nAll about 8"]
