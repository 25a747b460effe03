"""Cases in which the corpus operators once did less than the whole job."""
import random

import pytest

from fleetsieve.llm import html_extract, mixing

DOCS = "doc_id bigint, text string, source string"


def _plan(spark, sizes, **settings):
    docs = spark.createDataFrame([(i, "w " * n, "a") for i, n in enumerate(sizes)], DOCS).repartition(3)
    plan = mixing.plan_mix(docs, **settings).toPandas()
    return plan.assign(copies=plan.shards.map(len))


def test_mix_skips_a_document_larger_than_the_room(spark):
    plan = _plan(spark, [100] * 1000 + [150_000], share=0.25)
    assert (plan["size"] * plan.copies).sum() == 62_500 and plan.copies.max() == 1


def test_mix_walks_on_until_no_document_fits(spark, monkeypatch):
    monkeypatch.setattr(mixing, "SHARD_BLOCKS", 1)  # one block: the walk goes by shuffle_key
    rnd = random.Random(7)
    plan = _plan(spark, [int(rnd.lognormvariate(3, 2)) + 3 for _ in range(1500)], share=0.4, block_words=1 << 30, shards=1)
    left, taken, by_key = round(plan.target[0]), set(), plan.sort_values("shuffle_key")
    for i, n in zip(by_key.doc_id, by_key["size"]):
        if n <= left:
            taken.add(i)
            left -= n
    others = plan[~plan.doc_id.isin(taken)]
    assert left < others["size"].min()
    chosen = set(plan[plan.copies > 0].doc_id)
    assert taken <= chosen and len(chosen - taken) == (others["size"].min() < 2 * left)


def test_mix_deals_a_small_source_to_all_shards(spark):
    rnd = random.Random(8)
    plan = _plan(spark, [rnd.randint(1, 100) for _ in range(3000)], share=0.5)
    taken = plan[plan.copies > 0]
    assert abs((taken["size"] * taken.copies).sum() - plan.target[0]) <= 1
    words = taken.assign(shard=taken.shards.str[0]).groupby("shard")["size"].sum()
    assert len(words) == 16 and words.max() < 2.5 * words.mean()
    assert abs(taken["size"].mean() - plan["size"].mean()) < 3  # short ones are taken as often as long ones


@pytest.mark.parametrize("page, text", [
    ("<html><head><title>x</title><body><article><p>in</p></article>", "in"),
    ("<html><head><meta charset=utf-8><title>x</title><style>p{}</style></head><body><p>in</p>", "in"),
    ("<article><p>a</p><datalist><option>x<option>y</datalist><p>b</p></article>", "a\n\nb"),
    ("<article><p>a</p><datalist><option>x<option>y<p>b</p></article>", "a\n\nb"),
    ("<article><p>a</p><option>x<option>y<p>b</p><option>z</option></article>", "a\n\nb"),
    ("<article><p>a</p><script>var x = 1;<p>b</p></article>", "a\n\nb"),
    ("<article><p>a</p><title>x<p>b</p></article>", "a\n\nb"),
    *((f"<article><p>a</p><{name}><p>b</p></article>", "a\n\nb") for name in html_extract.SKIPPED)])
def test_an_element_without_its_end_loses_no_text(page, text):
    assert html_extract.main_text(page) == text


def test_many_elements_without_an_end_are_one_search():
    assert html_extract.main_text("<svg>" * 50_000 + "<p>in") == "in"


@pytest.mark.parametrize("bounds", [("<article>", "</article>"), ("<div>", "</div>")])
def test_links_do_not_empty_a_page_without_stop_words(bounds):
    texts = [f"{k} " + "lorem dolor sit amet consectetur adipiscing " * 6 for k in "abcd"]
    link, title = "<p><a href='/x'>vinculum nomen</a></p>", "<h1>Titulus</h1>"
    page = bounds[0] + title + link + f"<p>{texts[0]}</p><p>{texts[1]}</p>" + link + f"<p>{texts[2]}</p><p>{texts[3]}</p>" + link + bounds[1]
    whole = "\n\n".join(["Titulus", *map(str.strip, texts)])
    assert html_extract.main_text(page) == html_extract.main_text(page.replace(link, "")) == whole


def test_short_lines_among_links_stay_out():
    page = "".join(f"<div>item {i}</div><div><a href='/{i}'>link number {i}</a></div>" for i in range(5))
    assert html_extract.main_text(page) == ""


def test_short_paragraphs_of_an_article_survive_its_byline():
    assert html_extract.main_text("<article><p><a href='/x'>山田太郎</a></p><p>今日は晴れです。</p><p>明日は雨でしょう。</p></article>") == "今日は晴れです。\n\n明日は雨でしょう。"
