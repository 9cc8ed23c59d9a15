"""Main text of pages whose articles repeat headings, table heads and sentences from page to page."""

from __future__ import annotations

import random

from credence.llm import wrappers

SCHEMA = "page_id long, url string, html string"


def extracted(spark, rows):
    return {r.page_id: r.text for r in wrappers.extract(spark.createDataFrame(rows, SCHEMA)).collect()}


def test_shared_headings_stay(spark):
    html = "<main><h1>Cake {0}</h1><h2>Ingredients</h2><p>Flour {0}</p><h2>Method</h2><p>Mix {0}</p><table><tr><th>Time</th><td>{0} min</td></tr></table></main>"
    page = "<body><nav><a>Home</a></nav><div class=x><p>Welcome to the site</p></div>" + html + "<footer>Imprint</footer></body>"
    got = extracted(spark, [(i, f"http://cake.org/{i}", page.format(i)) for i in range(3)])
    assert got == {i: f"Cake {i}\n\nIngredients\n\nFlour {i}\n\nMethod\n\nMix {i}\n\nTime\n\n{i} min" for i in range(3)}


def test_against_the_blocks_that_were_written(spark):
    """Articles of blocks that are drawn from a few common ones and own ones, in pages with the same frame."""
    dice = random.Random(11)
    common = [("h2", "Summary"), ("p", "All rights of the reader remain."), ("li", "See above"), ("td", "Total"), ("blockquote", "So it is said")]
    rows, want = [], {}
    for i in range(40):
        blocks = [dice.choice(common) if dice.random() < 0.6 else (dice.choice(["p", "h3", "div"]), f"own {i} {k}") for k in range(dice.randint(1, 12))]
        body = "".join(f"<{tag}>{text}</{tag}>" for tag, text in blocks)
        rows.append((i, f"https://h{i % 3}.org/{i}", f"<html><body><header>Site</header><div><p>Welcome</p></div><article>{body}</article><aside>links</aside></body></html>"))
        want[i] = "\n\n".join(text for _, text in blocks)
    assert extracted(spark, rows) == want
