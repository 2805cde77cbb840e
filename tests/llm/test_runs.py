"""Periodic runs against brute force."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from corpus import documents, frame

from tallyloom.llm import periodic_runs


def brute_runs(words):
    """By definition: maximal stretches of each period from the smallest on, without those that a smaller period has."""
    n, found = len(words), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i < n - q:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j < n - q and words[j] == words[j + q]:
                j += 1
            length = j + q - i
            if length >= max(6, 4 * q) and not any(all(words[x] == words[x + p] for x in range(i, i + length - p)) for p in range(1, q)):
                found.append((i, length, q))
            i = j
    return sorted(found, key=lambda r: (r[0], r[2]))


def brute(rows):
    out = []
    for doc_id, text, *_ in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        n, h = len(w), 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]
        found = brute_runs(w)
        drop = {i for s, length, q in found for i in range(s + q, s + length)}
        s, length, q = min(found, key=lambda r: (-r[1], r[0], r[2])) if found else (None, None, None)
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        out.append((doc_id, len(found), s, length, q, 1000 * length // q if found else None, sha("".join(f"{a},{b},{c}\n" for a, b, c in found)), sha(" ".join(x for i, x in enumerate(w) if i not in drop))))
    return sorted(out, key=repr)


def made(seed):
    rng = random.Random(seed)
    words = ["a", "b", "c", "é", "A"]
    rows = []
    for i in range(60):
        parts = []
        for _ in range(rng.randint(1, 6)):
            unit = [rng.choice(words) for _ in range(rng.choice([1, 1, 2, 3, 4, 6, 13, 17]))]
            parts += (unit * rng.randint(2, 7))[: rng.randint(3, 90)] + [rng.choice(words) for _ in range(rng.randint(0, 4))]
        rows.append((i + 100, rng.choice([" ", "\n", " \t"]).join(parts), "s"))
    return rows


@pytest.mark.parametrize("apart", [1 << 16, 1, 300])
def test_periodic_runs(spark, tmp_path, monkeypatch, apart):
    monkeypatch.setattr(periodic_runs, "TOGETHER", apart)
    rows = [(i, t if t is None or len(t) < 9000 else t[:9000], s) for i, t, s in documents()] + made(apart)
    tenth = [i for i in range(2000) if zlib.crc32(str(i).encode()) % 10 == 0][:20]
    rows += [(i, " ".join(f"w{k % 31}" for k in range(n)), "s") for n, i in enumerate(tenth, 1)] + [(-4, "x " * 300 + "y " * 300, "s"), (-5, "x\x0by\x0c" * 50 + "    " * 40, "s")]
    frame(spark, rows).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = periodic_runs.query(spark, str(tmp_path)).drop("n_words").collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute(rows)


def test_of_an_empty_table(spark):
    assert periodic_runs.periodic_runs(frame(spark, [])).collect() == []


@pytest.mark.parametrize("probe", [2, 12, 1000])
def test_any_place_of_the_probe_finds_the_same(monkeypatch, probe):
    monkeypatch.setattr(periodic_runs, "PROBE", probe)
    rng = random.Random(probe)
    for _ in range(300):
        ids = []
        while len(ids) < rng.randint(5, 260):
            ids += [rng.randint(0, 2) for _ in range(rng.randint(1, 30))] * rng.choice([1, 1, 4, 5, 8])
        assert sorted(periodic_runs.runs(np.array(ids, np.int32), len(ids)), key=lambda r: (r[0], r[2])) == brute_runs(ids)


def test_texts_are_cut_at_white_space(monkeypatch):
    monkeypatch.setattr(periodic_runs, "PIECE", 5)
    data = b"  one twothree\x0bfour   \n five-six-seven  "
    known = {}
    ids = periodic_runs.word_ids(data, known)
    assert [list(known)[i] for i in ids] == data.split()


def test_long_texts_of_one_word_and_of_many(monkeypatch):
    """Lags in the thousands over 60,000 words: those inside the one long run are passed by."""
    ids = np.concatenate([np.zeros(40_000, np.int32), np.arange(1, 20_001, dtype=np.int32)])
    assert periodic_runs.runs(ids, len(ids)) == [(0, 40_000, 1)]
