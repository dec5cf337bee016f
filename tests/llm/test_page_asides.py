from __future__ import annotations

from dqspark.llm import html


def run(words, name):
    return " ".join(f"{name}{i}" for i in range(words))


def labelled(spark):
    """Pages that lead to strong weights, as the given ones do: asides stand outside the article only."""
    page = f"<body><nav>{run(30, 'n')}</nav><article><h1>{run(5, 't')}</h1><p>{run(200, 'w')}</p></article><div class='advert'>{run(40, 'a')}</div><footer>{run(20, 'f')}</footer></body>"
    return html.train(spark.createDataFrame([(page,)] * 20, "html string"))


def test_long_asides_inside_the_article_end_no_run(spark):
    model = labelled(spark)
    for aside in (f"<div class='advert'><p>{run(40, 'a')}</p></div>", f"<form><p>{run(60, 'a')}</p></form>", f"<div class='newsletter'><ul>{'<li>x y z</li>' * 30}</ul></div>"):
        for before, after in ((20, 300), (300, 20), (20, 20)):
            page = f"<body><nav>{run(30, 'n')}</nav><article><h1>{run(4, 't')}</h1><p>{run(before, 'b')}</p>{aside}<p>{run(after, 'c')}</p></article><footer>{run(20, 'f')}</footer></body>"
            assert html.main_text(page, model) == f"{run(4, 't')} {run(before, 'b')} {run(after, 'c')}"


def test_wrappers_of_the_content_are_no_asides(spark):
    model = labelled(spark)
    article = f"<article><h1>{run(4, 't')}</h1><p>{run(120, 'b')}</p><div class='related'><p>{run(30, 'r')}</p></div></article>"
    want = f"{run(4, 't')} {run(120, 'b')}"
    for start, end in (
        ("<div class='has-sidebar'>", "</div>"), ("<div id='content-with-sidebar'>", "</div>"), ("<div class='no-comments'>", "</div>"), ("<form action='x'>", "</form>"),
        ("<form><div class='has-sidebar'>", "</div></form>"), ("<aside>", "</aside>"),
    ):
        # long comments, so that the article alone has not most of the words
        page = f"<body>{start}<nav>{run(30, 'n')}</nav>{article}{end}<div class='comments'><p>{run(300, 'k')}</p></div></body>"
        assert html.main_text(page, model) == want, start
    plain = f"<body><form><div class='no-comments'><p>{run(120, 'b')}</p></div></form><form><p>{run(9, 'f')}</p></form></body>"
    assert html.main_text(plain, model) == run(120, "b")


def test_articles_in_asides_stay_asides(spark):
    model = labelled(spark)
    teasers = f"<div class='related'>{f'<article><p>{run(20, "r")}</p></article>' * 3}</div>"
    comments = f"<section id='comments'><article class='comment'><p>{run(90, 'k')}</p></article></section>"
    page = f"<body><article><p>{run(80, 'b')}</p></article>{teasers}{comments}</body>"
    assert html.main_text(page, model) == run(80, "b")


def test_marked_headings_and_items_inside_the_article_stay(spark):
    model = labelled(spark)
    page = (
        f"<body><nav>{run(30, 'n')}</nav><article><h2 class='section-header'>{run(4, 't')}</h2><p>{run(80, 'b')}</p><h3 id='related'>{run(3, 'u')}</h3>"
        f"<ul><li class='social'>{run(6, 'i')}</li></ul><label>{run(3, 'l')}</label><p>{run(60, 'c')}</p><div class='related'><h3>{run(3, 'x')}</h3></div>"
        f"<form><label>{run(4, 'y')}</label></form></article><h2 class='header'>{run(4, 'z')}</h2></body>"
    )
    want = " ".join([run(4, "t"), run(80, "b"), run(3, "u"), run(6, "i"), run(3, "l"), run(60, "c")])
    assert html.main_text(page, model) == want
