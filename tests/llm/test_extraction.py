import random
from itertools import product

import numpy as np
import pytest

from sequela.llm import extraction as X


def test_viterbi_and_marginals_equal_all_labellings():
    rng = np.random.default_rng(1)
    for n in (1, 2, 5):
        scores, move = rng.normal(size=(n, 2)), rng.normal(size=(2, 2))
        value = {
            path: sum(scores[i, a] for i, a in enumerate(path)) + sum(move[a, b] for a, b in zip(path, path[1:]))
            for path in product((0, 1), repeat=n)
        }
        assert tuple(X.viterbi(scores, move)) == max(value, key=value.get)
        total = sum(np.exp(v) for v in value.values())
        p, pairs = X.marginals(scores, move)
        for i in range(n):
            assert p[i, 1] == pytest.approx(sum(np.exp(v) for path, v in value.items() if path[i]) / total)
        want = np.zeros((2, 2))
        for path, v in value.items():
            for a, b in zip(path, path[1:]):
                want[a, b] += np.exp(v) / total
        assert pairs == pytest.approx(want)


def test_blocks_of_broken_and_odd_pages():
    page = (
        "<html><head><title>T</title><style>p{}</style></head><body><script>var a='</p>';</script>"
        "<p><b>One &amp; two<br>three<p>Four<!-- no --> five <i>six</i><ul><li>a<li>b</ul>tail &nbsp; end<img src=x>"
        "<template>no</template></div></p>last"
    )
    assert [b.text for b in X.blocks(page)] == ["One & two three", "Four five six", "a", "b", "tail end", "last"]
    assert X.blocks(None) == X.blocks("") == X.blocks("<p> </p>") == []
    assert [b.text for b in X.blocks("plain &lt;text&gt;")] == ["plain <text>"]
    nested = "<div>" * 3000 + "deep" + "</div>" * 3000
    assert [b.text for b in X.blocks(nested)] == ["deep"]


@pytest.fixture(scope="module")
def model(spark):
    pages, truth = [], []
    rng = random.Random(2)
    word = lambda: "".join(rng.choices("aeioustrnl", k=rng.randrange(2, 9)))
    line = lambda n: " ".join(word() for _ in range(n))
    for i in range(60):
        body = [line(rng.randrange(5, 60)) + "." for _ in range(rng.randrange(1, 8))]
        nav = "".join(f"<li><a href='/x'>{word()}</a></li>" for _ in range(5))
        html = (
            f"<html><body><nav><ul>{nav}</ul></nav><div class='ad'>{line(9)}.</div><article><h1>{body[0][:20]}</h1>"
            + "".join(f"<p>{b}</p>" for b in body)
            + f"</article><footer>&copy; {line(6)}.</footer></body></html>"
        )
        pages.append((i, f"u{i}", html))
        truth.append((i, "\n".join(body)))
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    known = spark.createDataFrame(truth[:30], "page_id long, main string")
    return df, truth, X.fit(df, known)


def test_held_out_pages(model):
    df, truth, field = model
    got = {r.page_id: r for r in X.extract(df, field).collect()}
    for i, main in truth[30:]:
        title, rest = got[i].text.split("\n", 1)
        assert rest == main and main.startswith(title)
        assert got[i].n_chars == len(got[i].text)


PARTS = {
    "header": "<header><p>Words of the head of the site, as a line.</p></header>",
    "nav": "<nav><a href='/'>Home</a> <a href='/b'>All</a></nav>",
    "aside": "<aside><p>Something else that you may like to read, now or then.</p></aside>",
    "cookies": "<div class='cookie-banner'><p>This site uses cookies for many things.</p></div>",
    "notice": "<div id='site-notice'>Please note that we are closed on Monday and Tuesday.</div>",
    "advert": "<div class='advert'>The best of all lamps, for a short time at half of the price.</div>",
    "form": "<form action='/s'><p>Tell us what you think of this.</p><input name=a><button>Go</button></form>",
    "comments": "<section id='comments'><h2>Comments</h2><div class='comment'><p>I do not agree with any of this at all, sorry.</p></div></section>",
    "footer": "<footer><p>All rights with the owner of this site, since then.</p></footer>",
}


@pytest.mark.parametrize("name", PARTS)
@pytest.mark.parametrize("place", ("before", "inside", "after"))
def test_parts_that_the_sample_lacks(model, name, place):
    if name == "header" and place == "inside":
        pytest.skip("a header inside an article is the article's own")
    _, _, field = model
    part = PARTS[name]
    body = "<h1>A title</h1><p>The first paragraph of the text, of some length.</p>{}<p>And <b>more</b>.</p><ul><li>one item</li></ul>"
    body = body.format(part if place == "inside" else "")
    html = f"<body>{part if place == 'before' else ''}<article>{body}</article>{part if place == 'after' else ''}</body>"
    want = "A title\nThe first paragraph of the text, of some length.\nAnd more.\none item"
    assert X.main_text(html, field) == want


def test_odd_rows(spark, model):
    _, _, field = model
    rows = [(1, None, None, "a"), (1, "u", "", "b"), (None, "u", "<article><p>x y</p></article>", "c"), (2, "u", "no & tags < here", "d")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = [tuple(r) for r in X.extract(df, field).collect()]
    assert got[0] == (1, None, "", 0) and got[1] == (1, "u", "", 0) and got[2] == (None, "u", "x y", 3)
    empty = df.limit(0)
    assert X.extract(empty, field).collect() == []
    assert X.fit(empty, spark.createDataFrame([], "page_id long, main string")).state
    long = "<article>" + "<p>" + "word " * 20_000 + "</p>" * 3 + "</article>"
    assert len(X.main_text(long, field)) == 5 * 20_000 - 1
