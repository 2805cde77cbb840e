"""Names of rows are exact; page text is decided by the host's wrapper."""

import random

import pytest
from pyspark.sql import functions as F

from tallyloom.llm import common, html_text


@pytest.mark.parametrize("bits", [38, 1, 0])
def test_rows_of_files_whose_digests_agree_keep_names_of_their_own(spark, tmp_path, monkeypatch, bits):
    """With one bit or none, files agree under every seed."""
    monkeypatch.setattr(common, "FILE_BITS", bits)
    spark.range(600).selectExpr("id % 3 AS k", "'same' AS text").repartition(6).write.parquet(f"{tmp_path}/t.parquet")
    docs = spark.read.parquet(f"{tmp_path}/t.parquet")
    named = common.numbered(docs, "row")
    assert named.select("row").distinct().count() == named.count() == 600
    assert named.exceptAll(named.select("k", "text", "row")).count() == 0  # another pass gives the same


def test_rows_beyond_the_bits_of_a_place(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(common, "PLACE_BITS", 4)
    spark.range(100).coalesce(1).write.parquet(f"{tmp_path}/t.parquet")
    assert common.numbered(spark.read.parquet(f"{tmp_path}/t.parquet"), "row").select("row").distinct().count() == 100


def test_the_mix_of_names_is_a_permutation(spark):
    """No two of many longs that differ in few bits get one digest."""
    longs = spark.range(64).selectExpr("id AS a").crossJoin(spark.range(64).selectExpr("id AS b")).selectExpr("shiftleft(1L, cast(a AS int)) | shiftleft(1L, cast(b AS int)) AS x").union(spark.range(100_000).selectExpr("id AS x")).distinct()
    assert longs.select(F.xxhash64("x")).distinct().count() == longs.count()


WORDS = "river stone market evening letter window garden history engine winter number signal harbour paper method result".split()


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n)).capitalize() + "."


def made_host(rng, name, pages):
    """(url, html, main text) of a host whose classes say nothing and whose menus, teasers and footers vary from page to page."""
    top, side, body, story, foot = rng.sample(["x", "qz", "k", "mm", "vv", "tb", "zz", "lw"], 5)
    depth = rng.randint(0, 3)
    out = []
    for i in range(pages):
        title, parts = sentence(rng, 4)[:-1], [sentence(rng, rng.randint(15, 40)) for _ in range(rng.randint(2, 7))]
        menu = "".join(f'<li><a href="/{rng.random()}">{rng.choice(WORDS)}</a>' for _ in range(rng.randint(3, 7)))
        text = "".join(f"<p>{p}" if rng.random() < 0.5 else f"<p>{p}</p>" for p in parts)
        note = "<p>Read our terms before you reply</p>" if rng.random() < 0.9 else ""
        main = f'<div class="{body}">' + "<div>" * depth + f'<h2>{title}</h2><div class="{story}">{text}{note}</div>' + "</div>" * depth + "</div>"
        teaser = f'<div class="{side}">{sentence(rng, 2)}</div>' if rng.random() < 0.8 else ""
        html = f'<html><head><title>{title}</title></head><body><div class="{top}"><ul>{menu}</ul></div>{teaser}{main}<div class="{foot}">{name} {i} {rng.choice(WORDS)}</div><script src=/{i}/>var t = "<p>{i}</p>";</script></body></html>'
        out.append((f"https://{name}/p/{i}", html, "\n".join([title, *parts])))
    return out


def test_the_wrapper_decides_where_no_name_tells_anything(spark):
    rng = random.Random(12)
    rows = [r for k in range(6) for r in made_host(rng, f"h{k}.example", 14)]
    table = spark.createDataFrame([(i, u, h) for i, (u, h, _) in enumerate(rows)], "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in html_text.extract(table).collect()}
    assert [got[i] for i in range(len(rows))] == [t for *_, t in rows]
    # each page as a host of its own: nothing is learned, and every text changes
    alone = {r["page_id"]: r["text"] for r in html_text.extract(table.withColumn("url", F.format_string("https://p%d.example/", "page_id"))).collect()}
    assert all(alone[i] != t for i, (*_, t) in enumerate(rows))


def test_masses_count_every_text_once():
    rng = random.Random(3)

    def tree(depth):
        if not depth or rng.random() < 0.2:
            return sentence(rng, 3)
        tag = rng.choice(["div", "section", "p", "a", "nav", "td"])
        return f"<{tag}>" + "".join(tree(depth - 1) for _ in range(rng.randint(0, 4))) + f"</{tag}>"

    for _ in range(40):
        page = "<body>" + tree(5) + "</body>"
        root = html_text.parse(page)
        places = {path[1].hex() for node, path, _ in html_text.nodes(root) if node.tag in html_text.CONTAINERS}

        def size(node, link=False):
            if isinstance(node, str):
                return 0 if link else len(" ".join(node.split()))
            return sum(size(k, link or node.tag == "a") for k in node.kids)

        found = html_text.masses(page, set(), places)
        assert found[""][2] == size(root) >= found[""][3]
        assert all(row[0] is None or row[2] <= found[row[0]][2] for row in found.values())
        held = {}
        for node, path, _ in html_text.nodes(root):
            held.setdefault(path[1].hex(), []).append(node)
        assert all(found[p][2] == size(held[p][0]) for p in found if p and len(held[p]) == 1)


def test_authors_keep_their_names_and_code_stays_out():
    page = lambda body: f"<html><body><article>{body}</article></body></html>"
    keep = {
        '<div class="share-price">42 EUR</div>': "42 EUR",
        '<section class="cookies">Bake</section>': "Bake",
        '<div class="market-share">A third</div>': "A third",
        '<header><h1>T</h1><p class="standfirst">Lead paragraph.</p><p>By someone</p></header>': "T\nLead paragraph.",
        "<script src=/js/>var x=1;</script><p>a": "a",
        '<style media="all"/>p{color:red}</style><p>b': "b",
        "<a href=/x/>link</a> text": "link text",
        '<div class="ad-box">Buy</div><div class="article-comments">Me</div><div class="share-buttons">Post</div><p>c': "c",
    }
    for body, text in keep.items():
        assert html_text.main_text(page(body), set()) == text
    assert html_text.main_text('<body><div class="modal-logic">Logic</div><div class="modal">Sign up</div></body>', set()) == "Logic"
