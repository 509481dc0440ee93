"""op1 on every page of the fixtures, against the pages' article read by itself."""

import html
import re

import pytest

from maskwright.llm.op1_html import op1_html_template_extraction


def article(page: str) -> str:
    body = re.search(r"<article>(.*?)(?:</article>|$)", page, re.S)[1]
    blocks = (" ".join(html.unescape(re.sub(r"<[^>]*>?", " ", x)).split()) for x in re.split(r"</?(?:p|h1)[^>]*>", body))
    return "\n".join(x for x in blocks if x)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_every_page(spark, sf):
    pages = {r.page_id: (r.url, article(r.html)) for r in spark.read.parquet(f"/root/testdata/{sf}/pages.parquet").collect()}
    rows = op1_html_template_extraction(spark, f"/root/testdata/{sf}").collect()
    assert len(rows) == len(pages)
    assert {r.page_id: (r.url, r.text) for r in rows} == pages
    assert all(r.n_chars == len(r.text) for r in rows)
