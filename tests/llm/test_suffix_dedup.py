from __future__ import annotations

import hashlib
import random

import pytest

from tidelog.llm.suffix_dedup import remove_repeats


def brute(rows: list[tuple[int, str | None]], length: int) -> dict[int, tuple]:
    """Every start of every document against a map from strings to their smallest document."""
    first: dict[bytes, int] = {}
    data = {i: (t or "").encode() for i, t in rows}
    for i, d in data.items():
        for p in range(len(d) - length + 1):
            s = d[p : p + length]
            first[s] = min(first.get(s, i), i)
    out = {}
    for i, d in data.items():
        gone = [False] * len(d)
        for p in range(len(d) - length + 1):
            if first[d[p : p + length]] < i:
                gone[p : p + length] = [True] * length
        kept = bytes(b for b, g in zip(d, gone, strict=True) if not g)
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out[i] = (len(d), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


def made(seed: int) -> list[tuple[int, str | None]]:
    r = random.Random(seed)
    words = ["alpha", "béta", "gamma", "delta", "日本", "omega", "x", "\n", "1234"]
    passages = [" ".join(r.choices(words, k=r.randint(5, 60))) for _ in range(6)]
    rows: list[tuple[int, str | None]] = [(100, None), (101, ""), (102, "short"), (103, "a" * 300), (104, "a" * 49), (105, "ab" * 200)]
    for i in range(60):
        parts = [r.choice(passages) if r.random() < 0.5 else " ".join(r.choices(words, k=r.randint(1, 40))) for _ in range(r.randint(1, 4))]
        rows.append((i, " ".join(parts)))
    rows += [(200 + i, rows[10][1]) for i in range(5)]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_brute_force(spark, seed):
    rows = made(seed)
    docs = spark.createDataFrame([(i, t, "clash") for i, t in rows], "doc_id long, text string, id string").repartition(3)
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in remove_repeats(docs, length=50).collect()}
    assert got == brute(rows, 50)


def test_null_ids_and_empty_table(spark):
    docs = spark.createDataFrame([(None, "z" * 80), (1, "z" * 80), (2, "z" * 80)], "doc_id long, text string")
    got = {r["doc_id"]: (r["n_removed"], r["kept"]) for r in remove_repeats(docs, texts=True).collect()}
    assert got == {None: (0, "z" * 80), 1: (0, "z" * 80), 2: (80, "")}
    assert remove_repeats(docs.limit(0)).count() == 0
