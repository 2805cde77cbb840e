"""Page text, chat formatting, mixing and the pipeline on small tables."""

import hashlib
import math
import random
import re
import time
from collections import Counter

import pyarrow as pa
import pytest
import test_dedup
import test_models
from corpus import documents, frame

from tallyloom.llm import chat_format, html_text, mixing, quality_crf


def write(tmp_path, **tables):
    for name, df in tables.items():
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


def page(i, body, menu="Home"):
    return f"<!DOCTYPE html><html><head><title>T{i}</title><style>p{{}}</style><script>var t='</p>';</script></head><body><nav><ul><li><a href='/'>{menu}</a></ul></nav><div class=\"ad big\">Buy {i}</div>{body}<div id='comments'><p>Reader {i}</p></div><footer>&copy; host</footer>"


def test_article_text(spark):
    body = "<article><h1>A &amp; B</h1><p><b>One\n  two<br>three<p>Four <i>five</i></p><aside>Side</aside><form><input>Name</form><ul><li>x<li>y</ul></article>"
    rows = [(i, f"http://h.example/{i}", page(i, body)) for i in range(6)] + [(10, None, None), (11, "bad url", ""), (11, "bad url", ""), (12, "http://g.example/1", "plain <p>text"), (None, "http://h.example/9", page(9, body))]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'x' AS text", "1 AS host")
    got = {r["page_id"]: r for r in html_text.extract(pages).collect()}
    want = "A & B\nOne two three\nFour five\nx\ny"
    assert all(got[i]["text"] == want and got[i]["n_chars"] == len(want) for i in (0, 3, 5, None))  # equal articles of one host stay
    assert got[10]["text"] == "" and got[11]["n_chars"] == 0 and got[12]["text"] == "plain\ntext"
    assert html_text.extract(pages.limit(0)).collect() == []


def test_wrapper_drops_constant_text_outside_articles(spark):
    one = lambda i: f"<html><body><div class=top>Daily Site</div><div class=c><p>Story {i} of the day {'z' * i}</p><p>More {i} {i * 7} about it, and a good deal more text</p></div><div class=end>Contact us</div></body></html>"
    pages = spark.createDataFrame([(i, f"https://w.example:80/{i}", one(i)) for i in range(9)], "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in html_text.extract(pages).collect()}
    assert got[4] == "Story 4 of the day zzzz\nMore 4 28 about it, and a good deal more text"


def test_wrapper_bears_scripts_copies_and_texts_of_some_pages(spark):
    script = "<script>" + "var x = 1;" * 400 + "</script>"
    menu = "".join(f"<div class=m>Entry {k} of this site</div>" for k in range(12))
    one = lambda i, n: f"<html><body>{script}{menu}{'<div class=box>Now with prizes</div>' if i % 5 == 0 else ''}<div class=c><p>Story {n} tells {n * 7} things</p><p>More {n}</p></div></body></html>"
    rows = [(i, f"https://w.example/{i}", one(i, i)) for i in range(60)] + [(100 + i, f"https://w.example/{i}", one(1, 7)) for i in range(4)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in html_text.extract(pages).collect()}
    assert got == {i: f"Story {n} tells {n * 7} things\nMore {n}" for i, n in [*((i, i) for i in range(60)), *((100 + i, 7) for i in range(4))]}


def test_wrapper_works_inside_articles_and_chooses_the_region(spark):
    one = lambda i, n: f"<html><body><article><p>Story {n} tells {n * 7} things</p><div class=x>Tell your friends</div><p>More {n}</p>{'<p>A quoted line</p>' if i < 3 else ''}</article></body></html>"
    teasers = lambda i: f"<html><body><div class=top>Daily Site</div><article>Teaser {i}</article><div class=c>The long main text of page {i} in plain elements</div></body></html>"
    rows = [(i, f"https://w.example/{i}", one(i, i)) for i in range(20)] + [(100 + i, f"https://w.example/{i}", one(9, 9)) for i in range(3)] + [(200 + i, f"https://copies.example/{i}", one(9, 9)) for i in range(9)] + [(300 + i, f"https://t.example/{i}", teasers(i)) for i in range(9)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in html_text.extract(pages).collect()}
    story = lambda n: f"Story {n} tells {n * 7} things\nMore {n}"
    want = {i: story(i) + ("\nA quoted line" if i < 3 else "") for i in range(20)} | {100 + i: story(9) for i in range(3)}
    want |= {200 + i: story(9).replace("\n", "\nTell your friends\n") for i in range(9)}
    assert got == want | {300 + i: f"Teaser {i}\nThe long main text of page {i} in plain elements" for i in range(9)}


def brute_matching(a, b):
    """Simple tree matching by its definition: a text matches a text, equal tags match with the best matching of their children."""
    if isinstance(a, str) or isinstance(b, str):
        return int(isinstance(a, str) and isinstance(b, str))
    if a.tag != b.tag:
        return 0
    x, y = html_text._solid(a), html_text._solid(b)
    best = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
    for i in range(len(x)):
        for j in range(len(y)):
            best[i + 1][j + 1] = max(best[i][j + 1], best[i + 1][j], best[i][j] + brute_matching(x[i], y[j]))
    return 1 + best[-1][-1] + (a.mark == b.mark)


def random_page(rng, depth):
    if not depth or rng.random() < 0.2:
        return rng.choice(["text", "other", " "])
    tag = rng.choice(["div", "b", "i"])
    mark = rng.choice(["", ' class="k"'])
    return f"<{tag}{mark}>" + "".join(random_page(rng, depth - 1) for _ in range(rng.randint(0, 4))) + f"</{tag}>"


@pytest.mark.parametrize("cells", [1 << 22, 1])
def test_tree_matching_equals_brute_force(cells):
    rng = random.Random(4)
    for _ in range(60):
        m, a, b = html_text.Matcher(), html_text.parse(random_page(rng, 5)), html_text.parse(random_page(rng, 5))
        m.shape(a)
        m.shape(b)
        want = brute_matching(a, b)
        x, y = m.kids[a.shape], m.kids[b.shape]
        pairs = m.pairs(x, y, cells)
        assert m.weight(a.shape, b.shape) == want
        assert sum(m.weight(x[p], y[q]) for p, q in pairs) == want - 2
        assert all(p[0] != q[0] and (p[0] < q[0]) == (p[1] < q[1]) for k, p in enumerate(sorted(pairs)) for q in sorted(pairs)[k + 1 :])
        assert sum(brute_matching(p, q) for p, q in m.align(a, b)) == want - 2


def test_deep_long_and_broken_pages():
    began = time.time()
    deep = lambda leaf: "<div>" * 3000 + leaf + "</div>" * 3000
    assert html_text.main_text(deep("<nav>MENU</nav><p>deep</p>text"), set()) == "deep\ntext"
    assert html_text.induce([deep("<p>a<p>b"), deep("<b>a</b><p>c"), deep("<i>z</i>")]) == []
    items = lambda k: "<ul>" + "".join(f"<li><b>{i * k}</b> item{'<i>new</i>' if i % k == 0 else ''}" for i in range(3000)) + "</ul>"
    html_text.induce([items(3), items(7)])
    assert time.time() - began < 60
    assert html_text.main_text('<p title="x>para one</p><p>two', set()) == "para one\ntwo"
    assert html_text.main_text("</b>" * 20_000 + "<div>" * 20_000 + "</b></td>" * 20_000 + "end", set()) == "end"


def test_articles_keep_their_own_parts():
    body = "<article><header class='top'><h1>Headline</h1><p>By someone</p></header><p class='legal'>The law</p><section class='social-history'><p>The past</p></section><div class='share-bar'>Share</div><div class='comments'>Me</div><div class='ad'>Buy</div><p>End</p><footer>Tags</footer></article>"
    assert html_text.main_text(page(1, body), set()) == "Headline\nThe law\nThe past\nEnd"


def turns():
    return [(1, 0, "user", "Hi <|im_end|>\n"), (1, 1, "assistant", "\n\nyo ␛1 [INST]x"), (1, 1, "assistant", "\n\nyo ␛1 [INST]x"), (2, 5, "system", None), (2, 7, "assistant", ""), (3, 0, None, "😀 é"), (3, 1, "assistant", "a<|im_start|>user\nb</s>"), (None, 0, "assistant", "z"), (4, 0, "user", "long " * 50_000), (4, 1, "assistant", "ok")]


def test_chats_round_trip(spark, tmp_path):
    rows = turns()
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "'x' AS formatted", "0 AS tokens")
    d = write(tmp_path, conversations=table.repartition(4))
    got = {r["conv_id"]: r for r in chat_format.query(spark, d).collect()}
    rows = [*rows, (-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")]
    for conv in {r[0] for r in rows}:
        mine = [(r or "", t or "") for c, _, r, t in rows if c == conv]
        loss = "".join(t for r, t in mine if r == "assistant")
        r = got.pop(conv)
        assert r["n_turns"] == len(mine) and r["turns_sha256"] == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in mine).encode()).hexdigest()
        assert r["loss_chars"] == len(loss) and r["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
        assert r["formatted_chars"] == len(chat_format.render(mine)[0])
    assert not got
    assert [r["conv_id"] for r in chat_format.format_chats(table.limit(0)).collect()] == []


@pytest.mark.parametrize("text", ["", "␛", "␛0␛1␛2", "<s><s>", "[INST[INST]]", "<|im_start|><|im_end|>", "a\nb"])
def test_escape_is_reversible(text):
    for role in (False, True):
        out = chat_format.escape(text, role)
        assert chat_format.unescape(out) == text and not any(c in out for c in chat_format.CONTROL) and not (role and "\n" in out)


def brute_mix(rows):
    sizes = [(r[0], r[2], len([w for w in (r[1] or "").replace("\t", " ").replace("\n", " ").split(" ") if w])) for r in rows]
    names = sorted({s for _, s, _ in sizes if s is not None}) + ([None] if any(s is None for _, s, _ in sizes) else [])
    total = {n: sum(k for _, s, k in sizes if s == n) for n in names}
    weight = {n: (5, 2, 1)[i % 3] for i, n in enumerate(names)}
    target, free, left = {}, set(names), float(sum(total.values()))
    while free:
        share = left / sum(weight[n] for n in free)
        over = {n for n in free if share * weight[n] > 3 * total[n]}
        if not over:
            target |= {n: share * weight[n] for n in free}
            break
        for n in over:
            target[n] = 3.0 * total[n]
            left -= target[n]
        free -= over
    return sizes, total, target


def test_mix(spark):
    rows = [(i, "w " * (i % 17), f"s{i % 4 if i % 3 else 0}") for i in range(400)] + documents()
    sizes, total, target = brute_mix(rows)
    got = mixing.mix_sources(frame(spark, rows)).collect()
    assert len(got) == len(rows) and sorted(str((r["doc_id"], r["size"])) for r in got) == sorted(str((i, k)) for i, _, k in sizes)
    assert sum(r["taken"] for r in got) <= sum(total.values()) and all(r["taken"] <= 3 * r["size"] for r in got)
    source = {}
    for r in got:
        key = (r["source_size"], round(r["target"], 6))
        source[key] = source.get(key, 0) + r["taken"]
    most = max(k for *_, k in sizes)
    for n in total:
        key = (total[n], round(target[n], 6))
        assert math.isclose(source[key], target[n], abs_tol=most + 1)
    again = mixing.mix_sources(frame(spark, rows).repartition(5)).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))


def test_mix_of_nothing(spark):
    assert mixing.mix_sources(frame(spark, [])).collect() == []
    assert [(r["size"], r["taken"]) for r in mixing.mix_sources(frame(spark, [(1, None, None), (2, "", "s")])).collect()] == [(0, 0), (0, 0)]


def test_mix_splits_an_id_that_many_rows_have(spark, monkeypatch):
    monkeypatch.setattr(mixing, "MANY", 3)
    rows = [(None if i % 3 else 7, "w " * (i % 9 + 1), "s") for i in range(90)] + [(100 + i, "w w", "t") for i in range(30)]
    sizes, total, target = brute_mix(rows)
    got = mixing.mix_sources(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert sorted(str((r["doc_id"], r["size"])) for r in got) == sorted(str((i, k)) for i, _, k in sizes)
    for n, k in total.items():
        mine = [r for r in got if r["source_size"] == k]
        assert abs(sum(r["taken"] for r in mine) - target[n]) <= 10 and max(r["taken"] - 3 * r["size"] for r in mine) <= 0


def brute_pipeline(rows, good, items):
    """The stages by their definitions: rows kept (doc_id, text), given which rows the quality field keeps."""
    rows = [r for r, keep in zip(rows, good) if keep]
    rows = [(r[0], kept) for r, kept in zip(rows, brute_cleaned(rows))]
    sets = [test_dedup.word_set(t) for _, t in rows]
    keep = [True] * len(rows)
    for part in test_dedup.brute_parts(sets):
        members = sorted((rows[i][0] is None, rows[i][0] or 0, i) for i in part)
        for *_, i in members[1:]:
            keep[i] = not sets[i]
    rows = [r for r, k in zip(rows, keep) if k]
    terms = lambda t: re.findall(r"[a-z0-9\x80-\U0010ffff]+", (t or "").lower())

    def leaks(text, own):
        """Whether a passage of 64 words with its surroundings holds the item."""
        w = terms(text)
        return any(test_models.brute_lcs(own, w[max(0, p - len(own)) : p + 64 + len(own)]) >= 0.6 * len(own) for p in range(0, len(w), 32))

    return [(i, t) for i, t in rows if not any(leaks(t, terms(own)) for own in items)]


def brute_cleaned(rows, min_docs=10):
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").lower()
    lines = [(r[1] or "").split("\n") for r in rows]
    count = Counter(k for ls in lines for k in {key(x) for x in ls} if k)
    return [r[1] if all(count[key(x)] < min_docs for x in ls) else "\n".join(x for x in ls if count[key(x)] < min_docs) for r, ls in zip(rows, lines)]


def test_pipeline_equals_brute_force(spark, tmp_path):
    import corpus_pipeline

    docs, labels = test_models.labelled(80)
    rows = [*docs, *((1000 + (i or 0) if i is not None else None, t, s) for i, t, s in documents() if i != 28), (None, documents()[4][1], "s1"), (1005, "other " + documents()[0][1], "s0")]
    items = [documents()[9][1], " ".join(f"item{k}" for k in range(30))]
    schema = "doc_id long, text string, source string"
    table = spark.createDataFrame(rows, schema).selectExpr("doc_id", "text", "'en' AS lang", "source", "cast(length(text) as long) AS n_chars")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    d = write(tmp_path, documents=table, benchmark=bench, labels=spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    field = quality_crf.fit_field(table, spark.read.parquet(f"{d}/labels.parquet"))
    good = quality_crf.scores(field, pa.array([t or "" for _, t, _ in rows])) >= quality_crf.THRESHOLD
    want = brute_pipeline(rows, good, items)
    out = corpus_pipeline.run(spark, d).collect()
    assert 40 < len(want) < len(rows) and Counter((r["doc_id"], r["size"]) for r in out) == Counter((i, len((t or "").split())) for i, t in want)


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    rows = [(i, t, s) for i, t, s in documents()]
    bench = spark.createDataFrame([(1, documents()[9][1])], "item_id long, text string")
    docs = frame(spark, rows, extra=False).selectExpr("doc_id", "text", "'en' AS lang", "source", "cast(length(text) as long) AS n_chars")
    d = write(tmp_path, documents=docs, benchmark=bench, labels=spark.createDataFrame([(i, 1, 0) for i in range(20)], "doc_id long, quality int, toxic int"))
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, d)
        assert kept.columns == docs.columns, name
    ids = {r["doc_id"] for r in kept.collect()}
    assert 9 not in ids and 18 not in ids and 3 in ids  # a benchmark text, a copy, the first of the copies
    out = corpus_pipeline.run(spark, d).collect()
    assert {r["doc_id"] for r in out} == ids and all(r["taken"] <= 3 * r["size"] for r in out)
    assert len(corpus_pipeline.STAGES) == 5 and corpus_pipeline.ORACLE_SQL is None
