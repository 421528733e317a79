"""The trap pages with models trained on given pages that have no <article>, and on mixed ones."""

import pytest

from tests.llm.test_main_text import BODY, PAGE, TEXT
from vigilar.llm.main_text import extract_main_text, main_text, train

ROOTS = ("<div class='wrapper'><div id='content'>%s</div></div>", "<div class='content'>%s</div>", "<div class='post'><div>%s</div></div>", "<article>%s</article>", "<main>%s</main>")
TRAPS = (
    "<div class='ad'>Buy it now, it is cheap.</div>",
    "<div class='comments'><div class='comment'><p>Nice text, thank you.</p></div></div>",
    "<p class='notice'>This site uses cookies.</p>",
)
DIVS = [PAGE % (r % (BODY + f"<p>Page {i}.</p>")) for i in range(66) for r in ROOTS[:3]]
ARTICLES = [PAGE % f"<article>{BODY}<p>Page {i}.</p>{''.join(TRAPS)}</article>" for i in range(100)]


@pytest.fixture(scope="module", params=["divs", "mixed"])
def model(request):
    return train(DIVS if request.param == "divs" else DIVS[:100] + ARTICLES)


@pytest.mark.parametrize("root", ROOTS)
def test_traps(model, root):
    assert main_text(PAGE % (root % BODY), model) == TEXT
    for trap in TRAPS:
        assert main_text(PAGE % (root % (BODY + trap)), model) == TEXT, trap
        assert main_text(PAGE % (root % (trap + BODY)), model) == TEXT, trap


def test_training_of_the_operator(spark):
    """Its own sample of a table without any <article>."""
    rows = [(i, "u", h) for i, h in enumerate(DIVS)]
    got = extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert all(r["text"] == f"{TEXT}\nPage {r['page_id'] // 3}." for r in got)
