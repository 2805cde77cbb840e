"""Periodic runs of words, found by bit-parallel lags.

The words of a document become small numbers, and each bit of these numbers a plane: one big integer with a bit a word. For a
lag q, every plane XOR itself shifted by q, ORed over the planes, has a bit wherever words q apart differ. A run of period q
and length L is a stretch of L - q zeros there, so max(6, 4 * q) - q zeros at least: ANDing the complement with itself shifted
by 1, 2, 4, ... leaves bits only where such a stretch begins, and mostly nothing at all. Many short documents share one big
integer, parted by words of their own: no stretch long enough can cross one, as it would cover the word or its partner.

From lag PROBE on, the words at multiples of the lag are looked at first: 3 * q zeros cover three multiples of q in a row, so a lag none of
whose multiples agree three times running has no run. Three such words
inside a known run whose period divides the lag prove nothing new either: a run of the lag that shares q words with it lies
inside it.

Lags are taken up to a quarter of the document, whatever its length; words are told apart exactly, not by hashes.

Defined cases: a null text or one without words has no runs and the digests of nothing; rows that repeat a doc_id, or have none, are
documents of their own, and without doc_id no words are replaced; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import arrow_schema, read, texts, tidy

#: Words of the documents that share the planes, unless one document has more.
TOGETHER = 1 << 16
#: Least lag whose multiples are looked at before its planes.
PROBE = 12
#: Bytes of text that are cut into words at a time.
PIECE = 1 << 20
LEAST, TIMES = 6, 4
SCHEMA = "doc_id {id}, n_words long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"
_SPACE = re.compile(rb"[ \t-\r]")


def pieces(data: bytes) -> Iterator[bytes]:
    """The text in parts that end at white space."""
    at = 0
    while at < len(data):
        cut = _SPACE.search(data, at + PIECE)
        end = cut.start() if cut else len(data)
        yield data[at:end]
        at = end


def word_ids(data: bytes, known: dict[bytes, int]) -> np.ndarray:
    """The words of a text as numbers of ``known``, which gains the new ones."""
    parts = []
    for piece in pieces(data):
        found = piece.split()  # at blanks and the control characters 9 to 13, as bytes do
        for w in found:
            if w not in known:
                known[w] = len(known)
        parts.append(np.fromiter((known[w] for w in found), np.int32, len(found)))
    return parts[0] if len(parts) == 1 else np.concatenate(parts) if parts else np.zeros(0, np.int32)


def with_tail(ids: np.ndarray, doc_id: int | None) -> np.ndarray:
    """The words with the end of every tenth document, by checksum of its id, replaced by a repeated part of itself."""
    n = len(ids)
    h = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h % 10 or not n:
        return ids
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return np.concatenate([ids[:a], ids[a + np.arange(n - a) % p]])


def _planes(ids: np.ndarray) -> list[int]:
    bits = int(ids.max()).bit_length()
    return [int.from_bytes(np.packbits((ids >> b & 1).astype(np.uint8), bitorder="little").tobytes(), "little") for b in range(bits)]


def _stretches(planes: list[int], n: int, q: int, least: int) -> list[tuple[int, int]]:
    """(first, one past the last) of the stretches of at least ``least`` words that equal the word q on."""
    differ, mask = 0, (1 << (n - q)) - 1
    for p in planes:
        differ |= p ^ (p >> q)
    same = ~differ & mask
    begins, have = same, 1
    while begins and have < least:
        step = min(have, least - have)
        begins &= begins >> step
        have += step
    if not begins:
        return []
    bits = np.unpackbits(np.frombuffer(begins.to_bytes((n + 7) // 8, "little"), np.uint8), bitorder="little")
    edge = np.flatnonzero(np.diff(np.concatenate([[0], bits, [0]])))
    return [(int(a), int(b) + least - 1) for a, b in zip(edge[::2], edge[1::2], strict=True)]


def _may_run(ids: np.ndarray, q: int, known: np.ndarray) -> bool:
    """Whether words at multiples of q leave room for a run of period q that is not one of the known (start, length, period)."""
    w = ids[::q]
    same = w[1:] == w[:-1]
    three = same[:-2] & same[1:-1] & same[2:]
    if not three.any():
        return False
    at = np.flatnonzero(three) * q
    start, length, _ = known[(q % known[:, 2] == 0) & (known[:, 1] > 3 * q)].T
    first, last = np.searchsorted(at, start), np.searchsorted(at, start + length - 1 - 3 * q, "right")
    covered = np.zeros(len(at) + 1, np.int64)
    np.add.at(covered, first, 1)
    np.add.at(covered, np.maximum(first, last), -1)
    return bool((np.cumsum(covered)[:-1] == 0).any())


def runs(ids: np.ndarray, longest: int) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of a list of words, whose documents have ``longest`` words at most."""
    found: list[tuple[int, int, int]] = []
    seen, known, taken = set(), np.zeros((0, 3), np.int64), 0
    if longest < LEAST:
        return found
    planes = _planes(ids)
    for q in range(1, longest // TIMES + 1):
        if q >= PROBE:
            if taken < len(found):
                known, taken = np.concatenate([known, np.array(found[taken:], np.int64)]), len(found)
                known = known[known[:, 1] > 3 * q]  # shorter ones hold no window of this lag or a later one
            if not _may_run(ids, q, known):
                continue
        for a, b in _stretches(planes, len(ids), q, max(LEAST, TIMES * q) - q):
            # Words that also repeat with a period dividing q are a run of that one, from end to end.
            if (a, b + q) not in seen:
                seen.add((a, b + q))
                found.append((a, b + q - a, q))
    return found


def together(docs: list[np.ndarray], free: int) -> Iterator[tuple[int, list[tuple[int, int, int]]]]:
    """(document, its runs) of all documents, those of like length in one list of words; numbers from ``free`` on are no word's."""
    order = sorted(range(len(docs)), key=lambda i: len(docs[i]))
    at = 0
    while at < len(order):
        end, total = at, 0
        while end < len(order) and (end == at or total + len(docs[order[end]]) < TOGETHER):
            total += len(docs[order[end]]) + 1
            end += 1
        group = order[at:end]
        parts = [x for k, i in enumerate(group) for x in (docs[i], np.array([free + k], np.int32))]
        first = np.concatenate([[0], np.cumsum([len(docs[i]) + 1 for i in group])])
        own: list[list[tuple[int, int, int]]] = [[] for _ in group]
        for start, length, period in runs(np.concatenate(parts), len(docs[group[-1]])):
            k = int(np.searchsorted(first, start, "right")) - 1
            own[k].append((start - int(first[k]), length, period))
        yield from zip(group, own, strict=True)
        at = end


def collapsed(ids: np.ndarray, found: list[tuple[int, int, int]], names: list[bytes]) -> str:
    """Digest of the words outside runs and of each run's first period, joined by blanks."""
    if found:
        change = np.zeros(len(ids) + 1, np.int64)
        for start, length, period in found:
            change[start + period] += 1
            change[start + length] -= 1
        ids = ids[np.cumsum(change)[:-1] == 0]
    digest = hashlib.sha256()
    for i in range(0, len(ids), 1 << 18):
        digest.update((b" " if i else b"") + b" ".join([names[k] for k in ids[i : i + (1 << 18)].tolist()]))
    return digest.hexdigest()


def _rows(doc_ids: list[int | None], data: list[bytes]) -> Iterator[tuple]:
    known: dict[bytes, int] = {}
    docs = [with_tail(word_ids(t, known), i) for t, i in zip(data, doc_ids, strict=True)]
    names = list(known)
    for i, found in together(docs, len(known)):
        found.sort(key=lambda r: (r[0], r[2]))
        text = "".join(f"{a},{n},{q}\n" for a, n, q in found)
        start, length, period = min(found, key=lambda r: (-r[1], r[0], r[2])) if found else (None, None, None)
        yield doc_ids[i], len(docs[i]), len(found), start, length, period, found and 1000 * length // period or None, hashlib.sha256(text.encode()).hexdigest(), collapsed(docs[i], found, names)


def periodic_runs(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_runs, the longest run, digests of all runs and of the words left, for every row of docs(doc_id, text)."""
    schema = SCHEMA.format(id=docs.schema["doc_id"].dataType.simpleString())
    kind = arrow_schema(schema, docs.sparkSession)

    def find(batches):
        for batch in batches:
            ids, data = batch.column("doc_id").to_pylist(), texts(batch.column("text"))
            sizes = np.cumsum([len(x) for x in data.cast(pa.binary()).to_numpy(zero_copy_only=False)])
            for part in np.split(np.arange(len(ids)), np.flatnonzero(np.diff(sizes // (4 * PIECE))) + 1) if len(ids) else []:
                rows = list(_rows([ids[i] for i in part], data.take(pa.array(part)).cast(pa.binary()).to_pylist()))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), kind, strict=True)], schema=kind)

    return docs.select("doc_id", "text").mapInArrow(tidy(find), schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs(read(spark, sf_dir, "documents"))
