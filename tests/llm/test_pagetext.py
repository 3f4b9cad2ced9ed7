import html
import random
import re

import numpy as np
import pytest

from terraquarry.llm import blocks, layouts, pagetext, queries
from pages_by_hand import PAGES


@pytest.fixture(scope="module")
def model(spark, sf):
    return pagetext.fit(spark.read.parquet(f"{sf}/pages.parquet"))


def article(page):
    """The article element of the tables' pages, read the plain way."""
    inside = page[page.index("<article>") + 9 : page.index("</article>")]
    parts = (" ".join(html.unescape(re.sub("<[^>]*>", " ", part)).split()) for part in re.split("</?(?:p|h1)>", inside))
    return "\n".join(p for p in parts if p)


def test_pages_of_other_layouts(model):
    for name, (page, want) in PAGES.items():
        read = blocks.read(page)
        got = "\n".join(b.text for b, good in zip(read, model.label([read])[0]) if good)
        assert got == want, name


def test_drawn_layouts_held_out(model):
    drawn = layouts.pages(300, [], seed=99)
    wrong = sum(int((np.array(labels) != got).sum()) for (_, labels), got in zip(drawn, model.label([p for p, _ in drawn])))
    assert wrong <= 0.03 * sum(len(labels) for _, labels in drawn)


def test_query_over_whole_tables(spark):
    sf = "/root/testdata/sf0.01"
    want = {r.page_id: (r.url, article(r.html)) for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    found = {r.page_id: r for r in queries.op11_pagetext(spark, sf).collect()}
    assert found.keys() == want.keys()
    assert all(r.url == want[i][0] and r.n_chars == len(r.text) for i, r in found.items())
    assert sum(r.text == want[i][1] for i, r in found.items()) >= 0.99 * len(want)


def test_blocks():
    text = lambda page: [b.text for b in blocks.read(page)]
    assert text("<p>a<p>b <i>c</i>d<br>e<ul><li>x<li>y <b>z</ul>tail &amp;amp; &nbsp;q&#x41;") == ["a", "b cd e", "x", "y z", "tail &amp; qA"]
    assert text("<b><p>text</b> more</p><table><tr><td>1<td>2</div><tr><td>3</table>after<!-- x --> y<!--> z w < 3 </ > v") == ["text more", "1", "2", "3", "after y z w < 3 v"]
    assert text("<div a='>' b=\"x>\">one</div><SCRIPT>var t='</p>'</script >two<style>p{}") == ["one", "two"]
    assert text("<select><option>1</select>hi<textarea>no</textarea><svg><text>s</text></svg><template>t</template>yes") == ["hi", "yes"]
    assert text("&copy &lt;b&gt; &#0;&#xD800;&#" + "9" * 5000 + ";&#0000000000065;&#" + "0" * 5000 + "66; &bogus; &am") == ["© <b> ���AB &bogus; &am"]
    for page in ("", " \n", "<", "<!--", "<a href='x", "</", "<!", "<script>"):
        assert text(page) == (["<"] if page == "<" else [])


@pytest.mark.parametrize("unit", ["<div>", "<p><b>", "<!-", "<a b='", "<li><div>", "<ul><li>", "<td>x</div>", "&#", "<x-y>t", "<", "</b>", "<table><tr><td>", "<b>x</i>"])
def test_broken_markup_takes_linear_time(unit):
    import time

    seconds = []
    for count in (20_000, 80_000):
        start = time.process_time()
        blocks.read(unit * count)
        seconds.append(time.process_time() - start)
    assert seconds[1] < 0.3 + 10 * seconds[0]


def test_windows_of_steps_give_the_same_scores(model, monkeypatch):
    pages = [p for p, _ in layouts.pages(12, [], seed=4)]
    whole = model.scores(pages)
    monkeypatch.setattr(pagetext, "STEPS", 5)
    for a, b in zip(whole, model.scores(pages)):
        assert np.allclose(a, b, atol=1e-5)
    assert [list(a) for a in model.label(pages)] == [list(b >= 0.5) for b in whole]


def test_gradients_by_differences():
    rng = np.random.default_rng(1)
    width = 8 * pagetext.HIDDEN
    model = pagetext.Model(rng.normal(0, 0.1, (pagetext.INPUT, width)), rng.normal(0, 0.2, (2, pagetext.HIDDEN, width // 2)), rng.normal(0, 0.5, 2 * pagetext.HIDDEN + 1))
    x, y = rng.normal(0, 0.3, (4, 3, pagetext.INPUT)), rng.integers(0, 2, (4, 3)).astype(float)
    mask = np.ones((4, 3, 1))
    mask[2:, 1] = 0
    x *= mask

    def loss():
        gates = x @ model.inward
        zero = (np.zeros((3, pagetext.HIDDEN)),) * 2
        both = np.concatenate([model.walk(gates[:, :, w * width // 2 : (w + 1) * width // 2], mask, w, zero)[0] for w in (0, 1)], 2)
        p = 1 / (1 + np.exp(-(both @ model.outward[:-1] + model.outward[-1])))
        return float(-(mask[:, :, 0] * (y * np.log(p) + (1 - y) * np.log(1 - p))).sum() / mask.sum())

    grads = pagetext._gradients(model, x, mask, y)
    draw = random.Random(2)
    for part, grad in zip((model.inward, model.across, model.outward), grads):
        got, want = [], []
        for _ in range(12):
            at = tuple(draw.randrange(n) for n in part.shape)
            held = part[at]
            part[at] = held + 1e-2
            up = loss()
            part[at] = held - 1e-2
            want.append((up - loss()) / 2e-2)
            part[at] = held
            got.append(grad[at])
        scale = np.linalg.norm(got) / np.linalg.norm(want)  # gradients may be shortened as a whole
        assert np.allclose(got, np.array(want) * scale, atol=2e-3 * np.abs(got).max() + 1e-6)


def test_edge_cases(spark, model):
    rows = [(1, "u", None), (2, None, ""), (None, "v", "<p>Some words stand here, and no more.</p>"), (4, "u", "<nav><a href=/>Home</a></nav>"), (5, "w", "<article>" + "<p>One line of text that goes on and on.</p>" * 5000 + "</article>"), (6, "x", "<article><p>" + "word " * 200_000 + "</p></article>")]
    table = spark.createDataFrame([(*r, "clash", 9) for r in rows + rows[:3]], "page_id long, url string, html string, text string, n_chars int")
    found = pagetext.extract(table, model).collect()
    assert len(found) == len(rows) + 3
    by_id = {r.page_id: r for r in found}
    assert [by_id[i].text for i in (1, 2, 4)] == ["", "", ""] and by_id[None].text == "Some words stand here, and no more." and by_id[2].url is None
    assert by_id[5].n_kept == 5000 and by_id[6].n_chars == 999_999
    assert pagetext.extract(table.limit(0), model).count() == 0
    assert pagetext.fit(table.limit(0), layouts_drawn=60).inward.shape == (pagetext.INPUT, 8 * pagetext.HIDDEN)
