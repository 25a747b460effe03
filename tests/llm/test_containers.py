"""Pages whose text stands in containers named like boilerplate, and vectors of any finite size."""
import random

import pytest
from pyspark.sql import functions as F

from fleetsieve.llm import html_extract, vector_search

LONG = "The quick brown fox jumps over the lazy dog and it was not a dream of the night for the people. " * 3
TEXT = LONG.strip()


@pytest.mark.parametrize("page, text", [
    (f'<form id="aspnetForm"><div><p>{LONG}</p></div></form>', TEXT),
    (f'<form role="form"><nav>Home</nav><article><p>{LONG}</p></article></form>', TEXT),
    (f'<div class="share-page search-engine-article"><p>{LONG}</p></div>', TEXT),
    (f'<div class="share"><article><h1>T</h1><p>{LONG}</p></article></div>', "T\n\n" + TEXT),
    (f'<body><nav><a href=x>Home</a><h1>Title</h1><p>{LONG}</p></body>', "Title\n\n" + TEXT),
    (f'<body><nav><a href=x>Home</a><article><p>{LONG}</p></article></body>', TEXT),
    (f'<article><p>{LONG}</p><section id="related-work"><p>{LONG}</p></section></article>', TEXT + "\n\n" + TEXT),
    (f'<div class=post><header><h1>Title here</h1></header><p>{LONG}</p></div>', "Title here\n\n" + TEXT),
    # what stays aside, however much it holds
    (f'<article><p>{LONG}</p></article><section class="post-comments"><article><p>{LONG * 3}</p></article></section>', TEXT),
    (f'<main><p>Short.</p></main><div class="left sidebar"><p>{LONG}</p></div>', "Short."),
    (f'<main><p>{LONG}</p></main><form><p>{LONG[:90]}</p></form>', TEXT),
    (f'<div hidden><p>{LONG}</p></div><p>seen</p>', "seen"),
    (f'<header><h1>Site</h1></header><div><p>{LONG}</p></div>', TEXT),
    (f'<p>{LONG}</p><footer><p>Imprint', TEXT)])
def test_containers_and_sections(page, text):
    assert html_extract.main_text(page) == text


def test_a_teaser_does_not_bound_the_page():
    assert TEXT in html_extract.main_text(f"<article>teaser card</article><div id=content><p>{LONG}</p></div>")


def test_deep_pages_end():
    html_extract.main_text("<nav><p>x" * 20_000)
    html_extract.main_text("<div class=share><form>x" * 20_000)


def brute(rows, k=10):
    whole = {i: [int(1024 * x // 1) for x in v] for i, v in rows}
    out = set()
    for q in whole:
        if q % 100 == 0:
            found = sorted(((-sum(a * b for a, b in zip(whole[q], v)), i) for i, v in whole.items() if i != q))[:k]
            out |= {(q, n + 1, i, max(-vector_search.LONG, min(vector_search.LONG, -s))) for n, (s, i) in enumerate(found)}
    return out


@pytest.mark.parametrize("size", [1.0, 7e4, 3e8, 8e12])
def test_every_finite_vector_takes_part(spark, size):
    draw = random.Random(5)
    rows = [(i, [draw.uniform(-1, 1) * size if i % 3 else float(draw.randint(-3, 3)) for _ in range(6)]) for i in range(230)]
    got = vector_search.top_k(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"), F.col("vec_id") % 100 == 0)
    assert {tuple(r) for r in got.collect()} == brute(rows)


def test_a_large_candidate_is_found(spark):
    rows = [(0, [1.0]), (1, [70000.0]), (2, [2.0])]
    got = vector_search.top_k(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"), F.col("vec_id") % 100 == 0)
    assert [tuple(r) for r in got.orderBy("rank").collect()] == [(0, 1, 1, 1024 * 71680000), (0, 2, 2, 2 * 1024 * 1024)]


def test_too_large_a_component_is_an_error(spark):
    rows = [(0, [1.0]), (1, [1e200])]
    with pytest.raises(Exception, match="beyond 2"):
        vector_search.top_k(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"), F.col("vec_id") % 100 == 0).collect()


def test_vectors_empty_table_nulls_and_clashing_columns(spark):
    kind = "vec_id bigint, embedding array<double>, row string, score int, query_row int"
    assert vector_search.top_k(spark.createDataFrame([], kind), F.col("vec_id") % 100 == 0).count() == 0
    rows = [(0, [1.0], "a", 1, 1), (1, None, "a", 1, 1), (2, [None], "a", 1, 1), (3, [float("nan")], "a", 1, 1), (4, [float("inf")], "a", 1, 1), (5, [2.0], None, None, None)]
    got = vector_search.top_k(spark.createDataFrame(rows, kind), F.col("vec_id") % 100 == 0).collect()
    assert [tuple(r) for r in got] == [(0, 1, 5, 2 * 1024 * 1024)]
