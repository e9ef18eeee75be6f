from __future__ import annotations

import random
import re
import tracemalloc
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidelog.llm import audio, chat_format, common, decontaminate, license_scan, ngram_join, quality, sentencepiece_codec, sharding, suffix_dedup, url_filter
from tidelog.llm import shingles as word_shingles
from tidelog.llm.components import connected_components
from tidelog.llm.queries import SENTENCEPIECE_MODEL, URL_RULES

DOCS = "doc_id long, text string, lang string, id string"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "en", "clash") for i, t in rows], DOCS)


def shingles(text: str | None, k: int = 5) -> set[tuple[str, ...]]:
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    return {tuple(words)} if 0 < len(words) < k else {tuple(words[i : i + k]) for i in range(len(words) - k + 1)}


def test_ngram_join_against_all_pairs(spark):
    r = random.Random(7)
    base = [[r.choice("abcdefghijkl") + str(r.randint(0, 30)) for _ in range(r.randint(3, 60))] for _ in range(12)]
    rows: list[tuple[int | None, str | None]] = [(500, None), (501, ""), (502, " \t "), (503, "One"), (504, "one"), (505, "two words")]
    for i in range(120):
        words = list(r.choice(base))
        for _ in range(r.choice([0, 0, 1, 2, 8])):
            words[r.randrange(len(words))] = str(r.random())
        rows.append((i, " ".join(words)))
    sets = {i: shingles(t) for i, t in rows}
    low = {i: i for i in sets}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    for _ in sets:
        for a, b in links:
            low[a] = low[b] = min(low[a], low[b])
    got = {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in ngram_join.similar_documents(docs_of(spark, rows)).collect()}
    assert got == {i: (len(s), low[i]) for i, s in sets.items()}


def test_components(spark):
    pairs = [(i, i + 1) for i in range(1, 40)] + [(100, 200), (200, 300), (None, 4), (7, 7)]
    got = {x["node"]: x["component"] for x in connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {i: 1 for i in range(1, 41)} | {100: 100, 200: 100, 300: 100}


def test_sharding(spark):
    r = random.Random(1)
    texts = ["x" * 5000, None, "", *["".join(r.choices("abcé", k=r.randint(1, 90))) for _ in range(150)]]
    rows = [(i, r.choice(texts[:1] * 20 + texts)) for i in range(400)] + [(3, "again"), (3, "again"), (None, "no id")]
    out = sharding.shard_rows(docs_of(spark, rows), shards=8).collect()
    assert len(out) == len(rows)
    assert sorted((x["size"], x["text_crc32"]) for x in out) == sorted((len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for _, t in rows)
    assert all(len({x["shard"] for x in out if x["text_crc32"] == c}) == 1 for c in {x["text_crc32"] for x in out})
    for shard in {x["shard"] for x in out}:
        assert sorted(x["slot"] for x in out if x["shard"] == shard) == list(range(sum(x["shard"] == shard for x in out)))
    assert sharding.shard_rows(docs_of(spark, rows).limit(0)).count() == 0


def test_packing_is_best_fit():
    assert sharding.pack([(0, 6), (1, 5), (2, 4), (3, 3)], 10) == {0: 0, 1: 1, 2: 0, 3: 1}
    assert len(set(sharding.even_out([(i, 10) for i in range(40)], 8).values())) == 8


def test_telephony_tables_and_round_trip(spark):
    # Fixed values of G.711: codes and their 16-bit samples.
    assert [int(audio.MULAW[c]) for c in (0x00, 0x7F, 0x80, 0xFF)] == [-32124, 0, 32124, 0]
    assert [int(audio.ALAW[c]) for c in (0xD5, 0x55, 0xAA, 0x2A)] == [8, -8, 32256, -32256]
    block = np.frombuffer(bytes([0, 1, 3, 0, 0x07, 0x80]), np.uint8)
    value, index, want = 256, 3, [256]
    for code in (7, 0, 0, 8):
        step = int(audio.STEPS[index])
        change = (step >> 3) + (step >> 2) * (code & 1) + (step >> 1) * (code >> 1 & 1) + step * (code >> 2 & 1)
        value += -change if code & 8 else change
        index = min(88, max(0, index + int(audio.INDEX_MOVES[code])))
        want.append(value)
    assert audio.decode_ima(block, 6)[:, 0].tolist() == want
    rows = spark.createDataFrame([(1, bytes(range(256))), (2, b""), (3, None)], "doc_id long, payload binary")
    for codec in ("mulaw", "alaw", "pcm"):
        back = {x["doc_id"]: x for x in audio.decode_audio(audio.store_audio(rows, "payload", codec=codec)).collect()}
        assert bytes(back[1]["samples"]) == bytes(range(256)) and bytes(back[2]["samples"]) == b"" and back[3]["audio_error"] == "no media"
    assert audio.decode_audio(spark.createDataFrame([(b"RIFFjunk",)], "media binary")).first()["audio_error"]


def test_quality_classifier_on_held_out_rows(spark):
    r = random.Random(2)
    good = lambda: " ".join("".join(r.choices("etaoinshr", k=r.randint(2, 8))) for _ in range(60)).capitalize() + "."
    bad = lambda: " ".join(r.choice(["$$$", "BUY", "!!!", "##", "click"]) for _ in range(60))
    rows = [(i, good() if i % 2 else bad()) for i in range(300)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)] + [(None, 1), (5, None)], "doc_id long, quality int")
    model = quality.learn(docs_of(spark, rows), labels)
    scored = quality.score_texts(docs_of(spark, [*rows, (900, None), (901, "")]), model).collect()
    assert all(0 <= x["score"] <= 1 for x in scored) and len(scored) == 302
    held = [x for x in scored if 200 <= x["doc_id"] < 300]
    assert sum((x["score"] >= 0.5) == bool(x["doc_id"] % 2) for x in held) >= 98
    assert quality.fit(np.zeros((0, len(quality.FEATURES))), np.zeros(0)).score(np.zeros((1, len(quality.FEATURES)))) == [0.5]


def test_decontamination_finds_other_numbers_and_names(spark):
    item = "A train leaves the old station at 40 km per hour and arrives after 3 hours, how far away is the next town called Norwich from there?"
    other = item.replace("40", "75").replace("3 hours", "9 hours").replace("Norwich", "Ipswich")
    clean = "Gardens need water in the morning, and a quiet evening walk through the park helps everyone to sleep well at night."
    docs = docs_of(spark, [(1, f"Intro words. {item} More words."), (2, f"Some start. {other}"), (3, clean), (4, None), (5, ""), (None, item), (6, clean * 50 + item)])
    bench = spark.createDataFrame([(10, item, "x"), (11, None, "x"), (12, "", "x")], "item_id long, text string, id string")
    got = {(x["doc_id"], x["item_id"]) for x in decontaminate.leaked_items(docs, bench).collect()}
    assert got == {(1, 10), (2, 10), (6, 10)}
    assert {x["doc_id"] for x in decontaminate.drop_leaks(docs, bench).collect()} == {3, 4, 5, None}
    assert decontaminate.leaked_items(docs.limit(0), bench).count() == 0


def test_decontamination_finds_copies_of_short_and_slot_heavy_items(spark):
    items = ["What is 17 plus 25?", "Who wrote War and Peace?", "The Old Man And The Sea Was Written By Ernest Hemingway In Cuba", "12 + 7 = 19, 13 + 8 = 21, 14 + 9 = 23, 15 + 10 = 25", "Photosynthesis"]
    bench = spark.createDataFrame([(i, x, "x") for i, x in enumerate(items)], "item_id long, text string, id string")
    docs = [(i, f"Some words stand before it: {x} And some more of them stand behind it.") for i, x in enumerate(items)]
    docs += [(i + 10, x) for i, x in enumerate(items)]
    docs += [(20, "1 + 2 = 3, 4 + 5 = 9, 6 + 7 = 13, 8 + 9 = 17"), (21, "We Saw The Big Red House And The Blue Garden Behind The Old Wall"), (22, "Who made soup and bread?"), (23, "war and peace")]
    got = {(x["doc_id"], x["item_id"]) for x in decontaminate.leaked_items(docs_of(spark, docs), bench).collect()}
    assert got == {(d + i, i) for i in range(len(items)) for d in (0, 10)}


def test_decontamination_judges_each_alignment(spark):
    item = "Add 12 to 30 then take 5 off, add 12 to 7 and give 5 back"
    other = "Add 81 to 44 then take 9 off, add 66 to 3 and give 2 back"
    near = "Add 81 to 44 then take 9 off"
    docs = docs_of(spark, [(1, f"{near}. {item}."), (2, f"{near}. {near}. Or so. {item}"), (3, other), (4, near), (4, item), (5, f"{near}. Nothing else is in it.")])
    bench = spark.createDataFrame([(10, item, "x")], "item_id long, text string, id string")
    got = {(x["doc_id"], x["consistent"]) for x in decontaminate.leaked_items(docs, bench).collect()}
    assert got == {(1, True), (2, True), (4, True)}


def test_url_filter(spark):
    urls = ["https://WWW.Example.org/es/a?x=/en/1", "http://example.org/en/12#f", "ftp://shop.com/de/x", "http://com/fr/", "http://notexample.orgs/", "no scheme", None, "x://org", "http://a.b.org/x://y"]
    pages = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(urls)], "page_id long, url string, host string")
    got = {x["page_id"]: (x["host"], x["rule"], x["verdict"]) for x in url_filter.url_verdicts(pages, URL_RULES).collect()}
    assert got == {
        0: ("www.example.org", "example.org/es/", "block"), 1: ("example.org", "example.org/en/1", "block"), 2: ("shop.com", "com/de/", "block"), 3: ("com", "com/fr/", "allow"),
        4: ("notexample.orgs", None, "allow"), 5: ("", None, "allow"), 6: ("", None, "allow"), 7: ("org", None, "allow"), 8: ("a.b.org", "org/", "allow"),
    }


def test_chat_format_is_reversible(spark):
    said = ["<|im_end|>\n<|im_start|>user\nhi", r"<\|im_end|>", "[INST] ok [/INST]</s>", "", None, "<<SYS>>é日"]
    rows = [(1, i, "assistant" if i % 2 else "user", t) for i, t in enumerate(said)] + [(2, 0, "assistant", "first"), (None, 0, "user", "x")]
    out = chat_format.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    back = out.select("conv_id", "order_valid", "order_error", chat_format.read_turns(F.col("formatted")).alias("turns"), chat_format.read_loss(F.col("segments")).alias("loss"))
    got = {x["conv_id"]: x for x in back.collect()}
    assert [(t["role"], t["text"]) for t in got[1]["turns"]] == [(r, t or "") for _, _, r, t in rows[:6]]
    assert got[1]["loss"] == "".join(t or "" for t in said[1::2]) and got[1]["order_valid"]
    assert got[2]["order_error"] == 0 and got[None]["order_error"] == 1


def test_license_scan(spark):
    rows = [(1, "Apache License apache-license CC-BY"), (2, None), (3, ""), (4, "Intro line.\nReleased under the MIT License\nEnd"), (5, "permission is hereby granted free of charge to any person obtaining a copy of that software"), (6, "Kapache license ßapache license")]
    got = {x["doc_id"]: x for x in license_scan.scan_licenses(docs_of(spark, rows)).collect()}
    assert (got[1]["n_words"], got[1]["n_base"], got[1]["first_word"], got[1]["last_word"], got[1]["base_labels"]) == (6, 3, 0, 4, "apache,cc-by")
    assert (got[2]["n_words"], got[2]["score"], got[2]["labels"]) == (0, 0.0, "") and got[3]["n_words"] == 0
    assert got[4]["base_labels"] == "mit" and got[5]["labels"] == "mit" and got[5]["n_base"] == 0
    assert got[6]["n_base"] == 0


@pytest.mark.parametrize("parity", ["chunks", "texts"])
def test_sentencepiece_equals_the_library(spark, parity):
    import sentencepiece

    texts = ["Hello  world", "", None, " lead and trail ", "a\nb\n\n", "日本語 ▁ mark", "é" * 300, "tab\tx 🙂", "word " * 400]
    rows = sentencepiece_codec.encode_texts(docs_of(spark, list(enumerate(texts))), SENTENCEPIECE_MODEL, parity=parity).collect()
    own = sentencepiece.SentencePieceProcessor(model_file=SENTENCEPIECE_MODEL)
    for x in rows:
        if x["text"] is None:
            assert x["ids"] is None and x["decoded"] is None
        else:
            assert x["ids"] == own.encode(x["text"]) and x["parity"] and x["n_tokens"] == len(x["ids"])
            assert x["decoded"] == own.decode(x["ids"])




def test_ngram_join_finds_links_between_two_pivots_cells(spark):
    # Sets along a line: documents 1 and 2 are pivots at the ends, 8 and 9 link them; 3 to 5 are in the same region, far from all.
    words = [f"w{i}" for i in range(400)]
    span = lambda a, b: " ".join(["q1 q2 q3 q4 q5", *words[a:b]])
    far = lambda n: " ".join(["q1 q2 q3 q4 q5", *(f"v{n}x{i}" for i in range(100))])
    rows = [(1, span(0, 100)), (8, span(0, 120)), (9, span(0, 150)), (2, span(0, 190)), *((i, far(i)) for i in (3, 4, 5))]
    got = {x["doc_id"]: x["component_id"] for x in ngram_join.similar_documents(docs_of(spark, rows)).collect()}
    assert got == {1: 1, 8: 1, 9: 1, 2: 1, 3: 3, 4: 4, 5: 5}


def test_shared_shingles_by_packed_arrays(spark, monkeypatch):
    from collections import defaultdict

    monkeypatch.setattr(ngram_join, "MEMBERS", 40)  # several slices and ranges
    rng = np.random.default_rng(3)
    common = [7, -9]  # one low and one high hash that every point has
    rows = [(i * 1000, 9, [int(x) for x in rng.permutation([*common, *(rng.integers(-(2**63), 2**63, 4) if i % 3 else [5, 6, 2**63 - 1, -(2**63)])])]) for i in range(60)]
    points = spark.createDataFrame(rows, "node long, n int, first array<long>").repartition(3)
    want, members = defaultdict(list), set()
    for node, _, first in rows:
        for at, token in enumerate(first):
            want[token].append((node, at))
    want = {t: v for t, v in want.items() if len(v) > 1}
    got = {x["token"]: x for x in ngram_join._shared(points).collect()}
    assert {t: (x["m"], x["one"], x["least_at"]) for t, x in got.items()} == {t: (len(v), min(v)[0], min(a for _, a in v)) for t, v in want.items()}
    assert len({(x["low"], x["high"]) for x in got.values()}) == 2  # the tokens of all points, and those of every third
    for x in ngram_join._regions(points).collect():
        members.add((x["token"], x["node"], x["at"]))
    kept = {t for t, _, _ in members}
    assert members == {(t, node, at) for t in kept for node, at in want[t]} and len(kept) == 2


def test_scores_without_moving_rows(spark):
    model = quality.Model()  # says a half
    rows = docs_of(spark, [(1, "some words"), (2, None)]).withColumn("more", F.lit("x"))
    out = quality.score_texts(rows, model)
    assert out.columns == [*rows.columns, "score"]
    assert "MapInArrow" not in out._jdf.queryExecution().executedPlan().toString()  # only the text goes to Python, only the score comes back
    assert [(x["doc_id"], x["more"], x["score"]) for x in out.orderBy("doc_id").collect()] == [(1, "x", 0.5), (2, "x", 0.5)]


def _peak_mb(work) -> float:
    tracemalloc.start()
    work()
    peak = tracemalloc.get_traced_memory()[1] / 1e6
    tracemalloc.stop()
    return peak


def test_worker_memory_of_the_ngram_join(monkeypatch):
    """A worker's peaks, by what it has at a time; before: 63 MB for these texts, 26 and 34 for 200,000 members that are sent and met."""
    monkeypatch.setattr(word_shingles, "_powers", {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)})
    texts = [" ".join(f"w{i * 7919 % 5000}" for i in range(j, j + 300)) for j in range(700)]
    assert _peak_mb(lambda: [len(s) for s in word_shingles.text_sets(texts, 5)]) < 20
    rng = np.random.default_rng(5)
    nodes, sets = list(range(2000)), [np.sort(rng.integers(-(2**63), 2**63, 100)) for _ in range(2000)]
    ngram_join._sent(nodes[:2], sets[:2], 4)  # imports
    assert _peak_mb(lambda: ngram_join._sent(nodes, sets, 4)) < 19
    found = ngram_join.pa.Table.from_batches([ngram_join._sent(nodes[i : i + 500], sets[i : i + 500], 4) for i in range(0, 2000, 500)])
    assert _peak_mb(lambda: ngram_join._meet(found)) < 17 and ngram_join._meet(found).num_rows == 0
    word_shingles.power("up", suffix_dedup.CHUNK)
    list(suffix_dedup._by_row(None, [], [])(iter([])))
    assert word_shingles._powers["up"].nbytes < 4e6  # an idle worker kept 32 MB


def test_ngram_join_sends_few_rows_at_a_time(spark, monkeypatch):
    """Batches have ROWS rows at most, 10,000 before; the setting is as it was afterwards."""
    key, sizes = "spark.sql.execution.arrow.maxRecordsPerBatch", []
    before, classes = spark.conf.get(key), ngram_join._classes

    def watched(*args):
        sizes.append(spark.conf.get(key))
        return classes(*args)

    monkeypatch.setattr(ngram_join, "_classes", watched)
    rows = [(1, "a b c d e f g"), (2, "A b c d e f g"), (3, None)]
    got = {x["doc_id"]: x["component_id"] for x in ngram_join.similar_documents(docs_of(spark, rows)).collect()}
    assert got == {1: 1, 2: 1, 3: 3} and sizes == [str(ngram_join.ROWS)] and spark.conf.get(key) == before


def test_batches_end_at_bytes_and_lose_no_row(spark):
    """Before, a batch ended at rows alone; a row larger than a batch is one by itself."""
    keys = [f"spark.sql.{k}" for k in ("execution.arrow.maxRecordsPerBatch", "execution.arrow.maxBytesPerBatch", "parquet.columnarReaderBatchSize")]
    before = [spark.conf.get(k) for k in keys]

    def sizes(batches):
        for b in batches:
            yield ngram_join.pa.RecordBatch.from_arrays([ngram_join.pa.array([b.num_rows]), ngram_join.pa.array([b.nbytes])], names=["n", "size"])

    wide = spark.range(60).selectExpr("id", "repeat('x', if(id % 20 = 7, 400000, 20000)) AS t").coalesce(1)
    with common.lean_batches(spark, 2000, 100_000):
        got = wide.mapInArrow(sizes, "n long, size long").collect()
    assert sum(x["n"] for x in got) == 60 and all(x["size"] < 150_000 or x["n"] < 6 for x in got) and len(got) > 10
    assert [spark.conf.get(k) for k in keys] == before


def test_worker_forgets_what_other_operators_keep():
    """Before, a codec and its known chunks, some 130 MB, stayed in a worker for the stages after it."""
    common.kept("sentencepiece")["codec"] = "large"
    assert list(common.tidy(iter, "sentencepiece")(iter([1]))) == [1] and common.kept("sentencepiece")
    assert list(common.tidy(iter)(iter([1]))) == [1] and not common.kept("sentencepiece")


def test_worker_memory_of_a_chunk():
    """Names by short tables of powers are those of long ones, within less memory: 40 bytes for each of a chunk's, more than 70 before."""
    n = 1_000_000
    body = np.random.default_rng(3).integers(97, 123, n).astype(np.uint8).tobytes()
    chunk = suffix_dedup.Chunk(np.arange(2), np.arange(2), np.array([n - 70_000, 70_000]), body)
    at = np.array([0, 5, 65_535, 65_536, n - 70_000, n - 50])
    letters = [int(x) for x in suffix_dedup._LETTER]
    for i, name in zip(at.tolist(), chunk.names(at, 50).tolist(), strict=True):
        exact = sum(letters[c] * pow(word_shingles._BASE, k, 2**64) for k, c in enumerate(body[i : i + 50])) % 2**64
        assert name == int(word_shingles.mix(np.array([exact], np.uint64))[0])
    chunk.total = None
    assert _peak_mb(lambda: suffix_dedup._first_sort(chunk, 50, 13, 40)) < 40
    marks = np.arange(0, n - 60, 900)
    assert _peak_mb(lambda: chunk.ahead(marks, 13)) < 20 and chunk.ahead(marks, 13).sum() == 13 * len(marks)


def test_shrink_collects_an_executors_garbage(spark):
    """In local mode the executor is the driver's JVM; before, only a driver's garbage was collected."""

    def collections() -> int:
        beans = spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans()
        return sum(b.getCollectionCount() for b in beans)

    before = collections()
    common.shrink(spark)
    assert collections() >= before + 2 * spark.sparkContext.defaultParallelism
