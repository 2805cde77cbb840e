"""Quality field, quality rules, toxicity chain and decontamination: held-out accuracy and brute force on small tables."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from corpus import documents, frame, prose
from pyspark.sql import functions as F

from tallyloom.llm import decontaminate, quality_crf, quality_rules, toxicity


def write(tmp_path, **tables):
    for name, df in tables.items():
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


def junk(rng, n):
    return "\n".join(" ".join(w + rng.choice(["***", "&&&", "###"]) for w in prose(rng, 12).split()) for _ in range(n))


def labelled(n=240, seed=5):
    rng = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        good, toxic = i % 4 != 0, i % 5 == 0
        text = "\n".join(prose(rng, rng.randint(8, 30)) + "." for _ in range(rng.randint(1, 6))) if good else junk(rng, rng.randint(1, 5))
        if toxic:
            text += f" you {rng.choice(['grubby', 'vile', 'rotten'])} thing"
        docs.append((i, text, "s"))
        labels.append((i, int(good), int(toxic)))
    return docs, labels


def odd_rows():
    return [(1000, "", "s"), (1001, None, "s"), (None, "one line", "s"), (1002, "x " * 40_000, "s"), (1002, "x " * 40_000, "s")]


def test_quality_field_on_held_out_rows(spark, tmp_path):
    docs, labels = labelled()
    d = write(tmp_path, documents=frame(spark, docs + odd_rows()), labels=spark.createDataFrame([*labels, (3, None, None)], "doc_id long, quality int, toxic int"))
    got = quality_crf.query(spark, d).collect()
    assert len(got) == len(docs) + 5 and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in got)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got if r["doc_id"] is not None)
    truth = {i: q for i, q, _ in labels}
    held = [r for r in got if r["held_out"] and r["doc_id"] in truth]
    assert np.mean([r["predicted"] == truth[r["doc_id"]] for r in held]) > 0.95
    kept = quality_crf.stage(spark, frame(spark, docs, extra=False), d)
    assert kept.columns == ["doc_id", "text", "source"] and kept.count() == sum(r["predicted"] for r in got if r["doc_id"] in truth)


def test_field_without_labels_or_rows(spark, tmp_path):
    d = write(tmp_path, documents=frame(spark, documents()), labels=spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert {round(r["score"], 6) for r in quality_crf.query(spark, d).collect()} == {0.5}


def brute_features(line, before):
    """A line's own features, by their definition; before: the text up to the line."""
    every = re.findall("[^\x20\x09-\x0d]+", before + line)
    words = re.findall("[^\x20\x09-\x0d]+", line)
    size, b = len(line.encode()), line.encode().decode("latin-1")
    share = lambda chars: 4 * sum(c in chars for c in b) / max(size, 1)
    at = len(every) - len(words)
    same = sum(any(k <= i and every[i - k] == every[i] for k in (1, 2)) for i in range(at, len(every)))
    n = max(len(words), 1)
    classes = ["ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789", "#*$%&<>", "|", "!?", ".,;:", "@/\\_=+~^{}[]()"]
    return [*map(share, classes), same / n, np.log1p(size) / 8, np.log1p(n) / 6, min(size / n, 30) / 10, b[-1:] in tuple(".,;:"), b[:1].isascii() and b[:1].isupper(), not size]


def test_scores_equal_brute_force():
    rng = np.random.default_rng(3)
    field = quality_crf.Field(rng.normal(size=quality_crf.N_ALL), rng.normal(size=(2, 2)))
    docs = ["", "One line, with two two words.", "Été |#| 12\n\nGo go go!\nend", "a\n" * 5, " \t\nA.\n"]
    got = quality_crf.scores(field, pa.array(docs))
    for text, score in zip(docs, got):
        lines = text.split("\n")
        own = [brute_features(x, "\n".join([*lines[:i], ""])) for i, x in enumerate(lines)]
        blank = [0.0] * quality_crf.N_OWN
        x = np.array([[*own[i], *(own[i - 1] if i else blank), *(own[i + 1] if i + 1 < len(own) else blank), 1.0] for i in range(len(own))], float)
        e, weight, total = x @ field.weights, np.zeros(len(lines)), 0.0
        for k in range(2 ** len(lines)):
            y = [(k >> i) & 1 for i in range(len(lines))]
            w = np.exp(sum(e[i] for i in range(len(y)) if y[i]) + sum(field.moves[p, q] for p, q in zip(y, y[1:])))
            total += w
            weight += w * np.array(y)
        size = np.array([len(x.encode()) + 1 for x in lines])
        assert score == pytest.approx((weight / total * size).sum() / size.sum())


def test_field_marginals_equal_enumeration():
    rng = np.random.default_rng(1)
    field = quality_crf.Field(rng.normal(size=quality_crf.N_ALL), rng.normal(size=(2, 2)))
    x, first = rng.normal(size=(7, quality_crf.N_ALL)), np.array([0, 4, 5, 7])
    got, e = field.marginals(x, first), x @ field.weights
    for a, b in zip(first, first[1:]):
        weight = {}
        for k in range(2 ** (b - a)):
            y = [(k >> i) & 1 for i in range(b - a)]
            weight[tuple(y)] = np.exp(sum(e[a + i] for i in range(b - a) if y[i]) + sum(field.moves[p, q] for p, q in zip(y, y[1:])))
        for i in range(b - a):
            assert got[a + i] == pytest.approx(sum(w for y, w in weight.items() if y[i]) / sum(weight.values()))


def brute_rules(text):
    text = text or ""
    words = re.findall("[^\x20\x09-\x0d]+", text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search("[^\x20\x09-\x0d]", line):
            dup += line in seen
            seen.add(line)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    count = Counter(windows)
    covered = {j for i, w in enumerate(windows) if count[w] > 1 for j in range(i, i + 8)}
    n = len(words)
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered), n < 20 or 100 * len(covered) > 30 * n


def test_quality_rules(spark, tmp_path):
    docs, labels = labelled()
    rows = docs + odd_rows() + [(r[0], r[1], r[2]) for r in documents()[12:]]
    d = write(tmp_path, documents=frame(spark, rows), labels=spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    got = quality_rules.query(spark, d).collect()
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    assert sorted((str(r["doc_id"]), *(r[k] for k in names)) for r in got) == sorted((str(i), *brute_rules(t)) for i, t, _ in rows)
    assert not any(r["kept"] and r["base_failed"] for r in got)
    raw, target = Counter(), Counter()
    slot = lambda t: [(int.from_bytes(t[k : k + 4], "little") * 2654435761 % 2**32) >> 16 for k in range(len(t) - 3)]
    good = {i for i, q, _ in labels if q}
    for i, t, _ in rows:
        raw.update(slot((t or "").encode()))
        target.update(slot((t or "").encode()) if i in good else [])
    sums = [sum(c.values()) for c in (raw, target)]
    ratio = {k: np.log((target[k] + 0.5) / (sums[1] + 0.5 * 2**16)) - np.log((raw[k] + 0.5) / (sums[0] + 0.5 * 2**16)) for k in raw}
    brute = sorted((str(i), round(float(np.mean([ratio[k] for k in s])) if (s := slot((t or "").encode())) else 0.0, 6), not brute_rules(t)[-1]) for i, t, _ in rows)
    assert sorted((str(r["doc_id"]), round(r["llr"], 6), not r["base_failed"]) for r in got) == brute
    assert all(r["kept"] == (not r["base_failed"] and round(r["llr"], 9) >= quality_rules.KEEP_FROM) for r in got)
    truth = {i: q for i, q, _ in labels}
    assert all(r["kept"] == bool(truth[r["doc_id"]]) for r in got if r["doc_id"] in truth and r["doc_id"] not in {x[0] for x in documents()} and not r["base_failed"])


def test_slot_ratios_equal_counting(spark):
    docs = frame(spark, [(1, "abcdef", "s"), (2, "abcdzz", "s"), (3, None, "s")])
    ratios = quality_rules.slot_ratios(docs, spark.createDataFrame([(1,), (None,)], "doc_id long"))
    raw, target = Counter(), Counter()
    for i, t in ((1, b"abcdef"), (2, b"abcdzz")):
        for k in range(3):
            slot = (int.from_bytes(t[k : k + 4], "little") * 2654435761 % 2**32) >> 16
            raw[slot] += 1
            target[slot] += i == 1
    for slot in raw:
        want = np.log((target[slot] + 0.5) / (3 + 0.5 * 2**16)) - np.log((raw[slot] + 0.5) / (6 + 0.5 * 2**16))
        assert ratios[slot] == pytest.approx(want)


def test_toxicity_chain(spark, tmp_path):
    docs, labels = labelled(600)
    d = write(tmp_path, documents=frame(spark, docs + odd_rows()), labels=spark.createDataFrame([*labels, (7, None, 1)], "doc_id long, quality int, toxic int"))
    got = {r["doc_id"]: r for r in toxicity.query(spark, d).collect()}
    assert all(got[i]["toxic"] == bool(t) for i, _, t in labels) and not got[1000]["toxic"] and not got[1001]["toxic"]
    assert set(got[0].asDict()) == {"doc_id", "p_low_quality", "p_toxic", "toxic"}
    chain = toxicity.fit_chain(frame(spark, docs), spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert {r["p_toxic"] for r in toxicity.predict(frame(spark, documents()), chain).collect()} == {0.5}


def test_linear_models_equal_brute_force():
    """The fit is where the penalised likelihood is flat, and a prediction is the sum over a text's features."""
    rng = np.random.default_rng(4)
    n = 300
    words = [{int(k) for k in rng.integers(0, 40, 8)} for _ in range(n)]
    y = np.array([float((3 in w or 5 in w) != (rng.random() < 0.1)) for w in words])
    earlier = rng.random((n, 1))
    h = np.array([k for w in words for k in sorted(w)], np.uint64)
    doc = np.array([i for i, w in enumerate(words) for _ in w])
    model = toxicity.fit_linear(h, doc, earlier, y)
    assert {3, 5} <= set(model.chosen.tolist())
    weight = dict(zip(model.chosen.tolist(), model.weights))
    odds = np.log(np.clip(earlier[:, 0], 1e-4, 1 - 1e-4) / np.clip(1 - earlier[:, 0], 1e-4, 1))
    z = np.array([sum(weight.get(k, 0) for k in w) for w in words]) + odds * model.weights[-2] + model.weights[-1]
    p = 1 / (1 + np.exp(-z))
    assert np.allclose(model.predict(np.repeat(h, 2), np.repeat(doc, 2), n, earlier), p)
    for k, w in weight.items():
        assert abs(sum(p[i] - y[i] for i in range(n) if k in words[i]) + toxicity.PENALTY * w) < 0.05
    assert abs((p - y).sum()) < 0.05


def test_the_threshold_has_the_best_f1(spark):
    rng = np.random.default_rng(2)
    for _ in range(50):
        n = int(rng.integers(2, 40))
        p, y = rng.integers(0, 9, n) / 8, rng.integers(0, 2, n).astype(float)
        t = toxicity.best_threshold(p, y)
        if 0 < y.sum() < n:
            f1 = lambda t: 2 * y[p >= t].sum() / ((p >= t).sum() + y.sum())
            assert f1(t) == pytest.approx(max(f1(x) for x in p))
        else:
            assert t == toxicity.THRESHOLD


def test_the_chain_by_hand():
    """Two categories: the second model and the threshold see the first through models that were fitted without a text's fold."""
    rng = np.random.default_rng(6)
    n = 240
    words = [{int(k) for k in rng.integers(0, 30, 7)} for _ in range(n)]
    y = np.array([[float((3 in w) != (rng.random() < 0.1)), float((5 in w) != (rng.random() < 0.1))] for w in words])
    fold = rng.integers(0, toxicity.FOLDS, n)
    pairs = lambda at: (np.array([k for i in at for k in sorted(words[i])], np.uint64), np.array([j for j, i in enumerate(at) for _ in words[i]]))
    every = list(range(n))

    def out_of_fold(k, earlier):
        out = np.zeros(n)
        for f in range(toxicity.FOLDS):
            rest = [i for i in every if fold[i] != f]
            model = toxicity.fit_linear(*pairs(rest), earlier[rest], y[rest, k])
            for i in np.flatnonzero(fold == f):
                out[i] = model.predict(*pairs([i]), 1, earlier[[i]])[0]
        return out

    first = out_of_fold(0, np.zeros((n, 0)))
    second = toxicity.fit_linear(*pairs(every), first[:, None], y[:, 1])
    last = out_of_fold(1, first[:, None])
    chain = toxicity.learn(*pairs(every), y, fold, ("a", "b"))
    assert np.allclose(chain.models[1].weights, second.weights) and chain.threshold == pytest.approx(toxicity.best_threshold(last, y[:, 1]))
    p = chain.predict(*pairs(every), n)
    assert np.allclose(p[:, 1], second.predict(*pairs(every), n, chain.models[0].predict(*pairs(every), n, np.zeros((n, 0)))[:, None]))


@pytest.mark.parametrize("most,texts", [(250_000, 40), (100, 10), (9, 0)])
def test_the_lines_of_the_fit_are_bounded_in_all(spark, monkeypatch, most, texts):
    monkeypatch.setattr(quality_crf, "ALL_LINES", most)
    seen = []
    monkeypatch.setattr(quality_crf.Field, "fit", lambda self, x, first, y: seen.append((len(x), len(y))) or self)
    docs = [(i, "\n".join(f"line {i} {k}" + "x" * i for k in range(10)), "s") for i in range(40)]
    labels = [(i, i % 2, 0) for i in range(40)]
    monkeypatch.setattr(quality_crf, "held_out", lambda doc_id="doc_id": F.lit(False))
    quality_crf.fit_field(frame(spark, docs), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert seen == ([(10 * texts, texts)] if texts else [])


def test_features_are_words_and_their_beginnings():
    def found(text):
        data = np.frombuffer(text.encode(), np.uint8)
        return set(toxicity.features(data, np.array([0, len(data)]))[0].tolist())

    assert found("Réeuxelle") & found("réeuxon") and not found("abcd") & found("abcde")
    assert len(found("abcdefghij abcd")) == 1 + 5 + 1 and found("") == set()


def brute_lcs(a, b):
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
    return best[-1][-1]


def test_lcs_equals_brute_force():
    rng = random.Random(2)
    for _ in range(200):
        a, b = ([rng.randrange(6) for _ in range(rng.randrange(15))] for _ in range(2))
        assert decontaminate.lcs(a, b) == brute_lcs(a, b)


def test_decontamination(spark, tmp_path):
    rng = random.Random(9)
    items = [(i, " ".join(f"w{rng.randrange(4000)}" for _ in range(rng.randint(18, 60)))) for i in range(30)]
    filler = lambda n: " ".join(f"w{rng.randrange(4000)}" for _ in range(n))
    docs = [(i, f"{filler(rng.randint(0, 150))} {t} {filler(rng.randint(0, 150))}", "s") for i, t in items]
    near = []
    for i, t in items:
        w = t.split()
        for k in rng.sample(range(len(w)), len(w) // 8):
            w[k] = "swapped"
        near.append((100 + i, f"{filler(40)} {' '.join(w).upper()} {filler(40)}", "s"))
    clean = [(200 + i, filler(300), "s") for i in range(60)]
    bench = spark.createDataFrame([*items, (50, None), (51, ""), (52, "word")], "item_id long, text string")
    d = write(tmp_path, documents=frame(spark, docs + near + clean + odd_rows()), benchmark=bench)
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.query(spark, d).collect()}
    assert got == {(i, i) for i, _ in items} | {(100 + i, i) for i, _ in items}
    plain = frame(spark, docs + near + clean, extra=False)
    kept = decontaminate.stage(spark, plain, d)
    assert kept.columns == plain.columns and {r["doc_id"] for r in kept.collect()} == {i for i, _, _ in clean}


def test_decontamination_finds_all_of_thousands_of_items(spark, tmp_path):
    rng = random.Random(10)
    some = lambda n: [f"w{int(5000 * rng.random() ** 3)}" for _ in range(n)]
    items = [some(rng.choice([2, 3, 5, 8, 15, 30, 59])) for _ in range(3000)]
    docs = []
    for i in range(160):
        w = list(rng.choice(items))
        for k in rng.sample(range(len(w)), int(len(w) * rng.choice([0, 0.15, 0.25, 0.35]))):
            w[k] = f"new{rng.randrange(99)}"
        docs.append(some(rng.randint(0, 150)) + w + some(rng.randint(0, 90)))
    want = set()
    for d, w in enumerate(docs):
        for p in range(0, len(w), 32):
            for i, own in enumerate(items):
                around = w[max(0, p - len(own)) : p + 64 + len(own)]
                there = set(around)
                if (d, i) not in want and sum(x in there for x in own) >= 0.6 * len(own) and brute_lcs(own, around) >= 0.6 * len(own):
                    want.add((d, i))
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id long, text string")
    path = write(tmp_path, documents=frame(spark, [(d, " ".join(w), "s") for d, w in enumerate(docs)]), benchmark=bench)
    got = [(r["doc_id"], r["item_id"]) for r in decontaminate.query(spark, path).collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) >= 160


def test_decomposition_gives_the_singular_vectors():
    rng = np.random.default_rng(5)
    x = (rng.normal(size=(300, 12)) * 0.5 ** np.arange(12)) @ rng.normal(size=(12, 60))
    vectors, values = decontaminate.nystroem(x.T @ x @ (omega := rng.normal(size=(60, 20))), omega)
    _, want, right = np.linalg.svd(x, full_matrices=False)
    assert np.allclose(values[:12], want[:12], rtol=1e-3) and (values[13:] < 1e-3 * want[0]).all()
    assert np.abs(np.abs((vectors[:, :8] * right[:8].T).sum(0)) - 1).max() < 1e-3


def test_sketch_equals_the_weighted_gram_matrix(spark):
    rows = documents()
    sketch = decontaminate.Sketch(frame(spark, rows).repartition(3))
    again = decontaminate.Sketch(frame(spark, rows).repartition(3))
    assert (sketch.gram == again.gram).all() and (sketch.idf == again.idf).all()
    df, blocks, counts = Counter(), 0, []
    for _, text, _ in rows:
        data = np.frombuffer((text or "").encode(), np.uint8)
        w, first = toxicity.terms(data, np.array([0, len(data)]))
        slot, block = decontaminate.pairs(w, first)
        n = max(1, -(-len(w) // decontaminate.BLOCK))
        blocks += n
        df.update(s for _, s in {(b, s) for b, s in zip(block.tolist(), slot.tolist())})
        counts += [slot[(block == b) | (block == b + 1)] for b in range(n)]
    assert all(sketch.idf[s] == pytest.approx(np.log((blocks + 1) / (k + 1)) + 0.05, rel=1e-5) for s, k in df.items())
    want = np.zeros_like(sketch.gram)
    for slot in counts:
        dim, weight = decontaminate.signed(sketch.idf, slot)
        np.add.at(want, dim, weight[:, None] * (weight @ sketch.omega[dim]))
    assert np.allclose(sketch.gram, want, rtol=1e-3, atol=1e-3 * np.abs(want).max())


def test_decontamination_of_paraphrases(spark, tmp_path):
    """Words replaced, or parts in another order, in a corpus of other texts: all are found down to the LCS bound."""
    rng = random.Random(12)
    filler = lambda n: [f"w{int(3000 * rng.random() ** 2)}" for _ in range(n)]
    items = [filler(rng.randint(25, 60)) for _ in range(40)]
    docs, want = [], set()
    for share in (0, 0.1, 0.2, 0.3, 0.35):
        for i, own in enumerate(items):
            w = list(own)
            for k in rng.sample(range(len(w)), int(len(w) * share)):
                w[k] = f"new{rng.randrange(9999)}"
            cut = len(w) // 4
            turned = w[cut:] + w[:cut] if share == 0.1 else w
            docs.append(filler(rng.randint(0, 90)) + turned + filler(rng.randint(0, 90)))
            want.add((len(docs) - 1, i))
    docs += [filler(200) for _ in range(200)]
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id long, text string")
    path = write(tmp_path, documents=frame(spark, [(d, " ".join(w), "s") for d, w in enumerate(docs)]), benchmark=bench)
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.query(spark, path).collect()}
    possible = {(d, i) for d, i in want if brute_lcs(items[i], docs[d]) >= 0.6 * len(items[i]) and brute_lcs(items[i], docs[d]) >= 0.5 * len(items[i])}
    assert got == possible and len(possible) > 0.9 * len(want)


def test_decontamination_of_empty_tables(spark, tmp_path):
    bench = spark.createDataFrame([(1, "a few words of an item")], "item_id long, text string")
    d = write(tmp_path, documents=frame(spark, []), benchmark=bench)
    assert decontaminate.query(spark, d).collect() == []
    assert decontaminate.find_matches(frame(spark, documents()), bench.limit(0)).collect() == []


def test_terms_and_pairs_stay_within_texts():
    text = pa.array(["One two,three", "", "four"])
    from tallyloom.llm.common import raw_bytes

    data, offsets = raw_bytes(text)
    h, first = toxicity.terms(data, offsets)
    assert first.tolist() == [0, 3, 3, 4]
    slot, block = decontaminate.pairs(h, first)
    assert len(slot) == 2 and block.tolist() == [0, 0]


def test_distinct_numbers_ascend():
    """Frequencies are counted from runs of distinct keys, whichever way those are found."""
    for x in ([], [0], [5, 0, 5, 0, 3], [7] * 9):
        assert decontaminate.distinct(np.array(x, np.int64)).tolist() == sorted(set(x))
