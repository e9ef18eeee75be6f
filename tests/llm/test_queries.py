"""The queries and the pipeline against brute force, over small tables with nulls, empties, repeats and clashing columns."""

from __future__ import annotations

import hashlib
import random
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidelog.llm import audio, chat_format, license_scan, quality, queries, sentencepiece_codec, sharding, suffix_dedup, url_filter
from tidelog.llm.common import table_path

from .test_operators import docs_of, shingles

LONG = "A passage of more than fifty bytes that stands in several of the documents, word for word and letter for letter. "


def some_documents() -> list[tuple]:
    r = random.Random(11)
    words = ["".join(r.choices("etaoinshrdlu", k=r.randint(2, 9))) for _ in range(300)]
    text = lambda n: " ".join(r.choice(words) for _ in range(n)).capitalize() + "."
    rows = [(i, text(r.randint(1, 120))) for i in range(60)]
    rows += [(100 + i, rows[i][1]) for i in range(8)] + [(120 + i, f"{rows[20 + i][1]} {LONG} {text(9)}") for i in range(6)]
    rows += [(200, None), (201, ""), (202, " "), (203, "x" * 576), (204, "é" * 100_000), (205, text(20_000)), (206, "one two"), (207, "one  two")]
    return [(i, t, "en", "web", len(t or ""), "kept", 1.0) for i, t in rows]


@pytest.fixture(scope="module")
def tables(spark):
    at = table_path(spark, "tables")
    docs = spark.createDataFrame(some_documents(), "doc_id long, text string, lang string, source string, n_chars long, kept string, quality_score double")
    docs.repartition(3).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(i, i % 2, 0) for i in range(60)], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame([(1, "What is the sum of the first hundred odd numbers in that long list?"), (2, None)], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return at


def test_sharding_query(spark, tables):
    rows = queries.op2_sharding(spark, tables).collect()
    want = sorted((d[0], len((d[1] or "").encode()) + 16, zlib.crc32((d[1] or "").encode())) for d in some_documents())
    assert sorted((x["doc_id"], x["size"], x["text_crc32"]) for x in rows) == want
    for shard in {x["shard"] for x in rows}:
        assert 0 <= shard < 40 and sorted(x["slot"] for x in rows if x["shard"] == shard) == list(range(sum(x["shard"] == shard for x in rows)))


def test_shards_are_near_equal_in_bytes(spark):
    r = random.Random(4)
    rows = [(i, "".join(r.choices("abcdefgh", k=r.randint(0, 400)))) for i in range(6000)] + [(9000 + i, "copy " * 40) for i in range(300)]
    sizes: dict[int, int] = {}
    for x in sharding.shard_rows(docs_of(spark, rows), shards=8).collect():
        sizes[x["shard"]] = sizes.get(x["shard"], 0) + x["size"]
    assert len(sizes) == 8 and max(sizes.values()) - min(sizes.values()) <= 0.01 * sum(sizes.values()) / 8


def test_tightest_bin_in_a_balanced_tree():
    r, tree, held = random.Random(3), sharding.Tightest(), []
    for i in range(2000):
        if held and r.random() < 0.5:
            size = r.randint(0, 1000)
            want = min((x for x in held if x[0] >= size), default=None)
            assert tree.take(size) == want
            held = [x for x in held if x != want]
        else:
            held.append((r.randint(0, 1000), i))
            tree.add(*held[-1])
        assert sharding._height(tree.tree) <= 1.45 * np.log2(len(held) + 2)


def test_media_query(spark, tables):
    got = {x["doc_id"]: x for x in queries.op3_media(spark, tables).collect()}
    assert {x["codec"] for x in got.values()} == {"mulaw", "alaw", "ima_adpcm"}
    for i, t, *_ in some_documents():
        data = (t or "").encode()
        payload = data + b"\xff" * (576 - len(data) % 576 if len(data) % 576 or not data else 0)
        media = audio.write_wav(payload, got[i]["codec"], 8000, 36 if got[i]["codec"] == "ima_adpcm" else 1)
        pcm = audio.to_mono(audio.to_pcm(audio.read_wav(media)))
        loud = audio.resample(pcm, 8000, 16000)
        assert (got[i]["n_bytes"], got[i]["payload_bytes"], got[i]["payload_sha256"]) == (len(data), len(payload), hashlib.sha256(payload).hexdigest())
        assert got[i]["tail_crc32"] == zlib.crc32(payload[-32:]) and got[i]["media_sha256"] == hashlib.sha256(media).hexdigest() and got[i]["media_bytes"] == len(media)
        assert got[i]["pcm_sha256"] == hashlib.sha256(loud.astype("<i2").tobytes()).hexdigest() and got[i]["pcm_bytes"] == 2 * len(loud)


def plain_ima(block: bytes) -> list[int]:
    value, index, out = struct.unpack_from("<h", block)[0], min(block[2], 88), []
    out.append(value)
    for byte in block[4:]:
        for code in (byte & 15, byte >> 4):
            step = int(audio.STEPS[index])
            change = (step >> 3) + (step >> 2) * (code & 1) + (step >> 1) * (code >> 1 & 1) + step * (code >> 2 & 1)
            value = max(-32768, min(32767, value - change if code & 8 else value + change))
            index = min(88, max(0, index + int(audio.INDEX_MOVES[code])))
            out.append(value)
    return out


def test_audio_blocks_channels_and_bad_headers(spark):
    r = random.Random(5)
    data = bytes(r.randrange(256) for _ in range(36 * 3 + 11))
    want = [x for k in range(0, len(data), 36) for x in plain_ima(data[k : k + 36])]
    assert audio.decode_ima(np.frombuffer(data, np.uint8), 36)[:, 0].tolist() == want
    left, right = (bytes(r.randrange(256) for _ in range(12)) for _ in range(2))
    both = left[:4] + right[:4] + left[4:8] + right[4:8] + left[8:] + right[8:]
    assert audio.decode_ima(np.frombuffer(both, np.uint8), 24, 2).T.tolist() == [plain_ima(left), plain_ima(right)]
    stereo = audio.write_wav(struct.pack("<4h", 100, 300, -5, -7), "pcm", 8000, 4, 2)
    eight = bytearray(audio.write_wav(bytes([128, 255, 0, 128]), "pcm", 8000, 1))
    eight[34:36] = struct.pack("<H", 8)
    files = {"stereo": stereo, "eight": bytes(eight), "none": None, "junk": b"RIFF....WAVEfmt ", "empty": audio.write_wav(b"", "ima_adpcm", 8000, 36)}
    for name, place, value in (("rate", 24, 0), ("channels", 22, 0), ("bits", 34, 7), ("format", 20, 85)):
        broken = bytearray(audio.write_wav(b"\1\2\3\4", "mulaw", 8000))
        broken[place : place + 2] = struct.pack("<H", value)
        files[name] = bytes(broken)
    for block in (0, 2, 4):
        broken = bytearray(audio.write_wav(bytes(36), "ima_adpcm", 8000, 36))
        broken[32:34] = struct.pack("<H", block)
        files[f"block{block}"] = bytes(broken)
    rows = spark.createDataFrame(list(files.items()), "name string, media binary")
    got = {x["name"]: x for x in audio.decode_audio(rows, to_rate=8000).collect()}
    pcm = lambda name: np.frombuffer(bytes(got[name]["pcm"]), "<i2").tolist()
    assert pcm("stereo") == [200, -6] and pcm("eight") == [0, 127 * 256, -32768, 0] and pcm("empty") == []
    assert all(got[n]["audio_error"] and got[n]["pcm"] is None for n in files if n not in ("stereo", "eight", "empty"))
    again = audio.store_audio(spark.createDataFrame([(b"x", b"\1\2")], "media binary, payload binary"), "payload")
    assert again.columns == ["media"] and again.first()["media"][:4] == b"RIFF"
    assert audio.decode_audio(rows.limit(0)).count() == 0


def test_templates_that_cannot_be_read_back_are_refused():
    for bad in ({"begin": "### ", "after_role": ":\n", "end": "\n\n"}, {"begin": "#"}, {"end": "<\\e>"}, {"after_role": ""}, {"begin": "<|a<|", "end": "|a"}):
        with pytest.raises(ValueError):
            chat_format.Template(**bad)


def test_another_template_is_reversible(spark):
    t = chat_format.Template(begin="{{turn ", after_role=": ", end="/turn}}", control=("{{turn ", "@@stop!!"))
    said = ["x /turn}}{{turn assistant: y", "{\\{turn ", " /turn}", "@@stop!! and @\\@stop!!", "%3A;", ": "]
    rows = [(1, i, "assistant" if i % 2 else "a:b%c", x) for i, x in enumerate(said)]
    out = chat_format.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), t)
    x = out.select("formatted", chat_format.read_turns(F.col("formatted"), t).alias("turns"), chat_format.read_loss(F.col("segments"), t).alias("loss")).first()
    assert [(y["role"], y["text"]) for y in x["turns"]] == [(r, s) for _, _, r, s in rows] and x["loss"] == "".join(said[1::2])
    assert x["formatted"].count("@@stop!!") == 0 and x["formatted"].count("{{turn ") == len(said)


def test_url_rules_as_a_table(spark):
    pages = spark.createDataFrame([(1, "http://a.example.org/es/x"), (2, None)], "page_id long, url string")
    rules = spark.createDataFrame([("block", "example.org", "/es/", 1), ("block", None, "/", 2)], "action string, host string, path string, page_id long")
    got = {x["page_id"]: (x["rule"], x["verdict"]) for x in url_filter.url_verdicts(pages, rules).collect()}
    assert got == {1: ("example.org/es/", "block"), 2: (None, "allow")}
    assert url_filter.url_verdicts(pages, rules.limit(0)).where("verdict = 'allow'").count() == 2


def test_licenses_across_lines_and_the_best_template(spark):
    texts = {
        1: "Intro.\n\nRedistribution and use in source and binary forms, with or without\nmodification, are permitted", 2: "Licensed under CC BY-NC 4.0.", 3: "Licensed under CC BY-SA 4.0.", 4: "Licensed under CC BY 4.0.",
        5: "Permission to use, copy, modify, and/or distribute this software for any\r\npurpose with or without fee is hereby granted", 6: "source and binary forms", 7: None,
    }
    got = {x["doc_id"]: x["labels"] for x in license_scan.scan_licenses(docs_of(spark, list(texts.items()))).collect()}
    assert got == {1: "bsd", 2: "cc-by,cc-by-nc", 3: "cc-by,cc-by-sa", 4: "cc-by", 5: "isc", 6: "", 7: ""}


def unigram_model() -> bytes:
    def number(n: int) -> bytes:
        out = b""
        while n > 127:
            out, n = out + bytes([n & 127 | 128]), n >> 7
        return out + bytes([n])

    def held(field: int, body: bytes) -> bytes:
        return number(field << 3 | 2) + number(len(body)) + body

    pieces = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3), ("<sep>", 0.0, 4)] + [("▁" + w, -2.0 - k / 7, 1) for k, w in enumerate(["the", "cat", "sat"])]
    pieces += [("▁", -3.0, 1)] + [(c, -4.0 - k / 9, 1) for k, c in enumerate("abcdehst")] + [("at", -3.1, 1), ("he", -3.3, 1)]
    proto = b"".join(held(1, held(1, p.encode()) + number(2 << 3 | 5) + struct.pack("<f", s) + number(3 << 3) + number(kind)) for p, s, kind in pieces)
    return proto + held(2, number(3 << 3) + number(1)) + held(3, held(1, b"identity") + number(3 << 3) + number(1) + number(4 << 3) + number(1) + number(5 << 3) + number(1))


def test_unigram_models_and_pieces_that_are_never_split(spark, tmp_path):
    import sentencepiece

    path = tmp_path / "unigram.model"
    path.write_bytes(unigram_model())
    own = sentencepiece.SentencePieceProcessor(model_file=str(path))
    texts = ["the cat sat", "that hat", "the<sep>cat", "<sep>", "chat  the ", "x the", "", "sathe"]
    rows = sentencepiece_codec.encode_texts(docs_of(spark, list(enumerate(texts))), str(path), parity="texts").collect()
    assert {x["text"]: list(x["ids"]) for x in rows} == {t: own.encode(t) for t in texts} and all(x["parity"] for x in rows)
    assert {x["text"]: x["decoded"] for x in rows} == {t: own.decode(own.encode(t)) for t in texts}


def test_decoding_leaves_out_control_pieces():
    import sentencepiece

    with open(queries.SENTENCEPIECE_MODEL, "rb") as f:
        proto = f.read()
    codec, own = sentencepiece_codec.Codec(proto, "none"), sentencepiece.SentencePieceProcessor(model_proto=proto)
    for ids in ([0, 15043], [1, 15043, 2], [15043, 0], [1, 2], [], [1, 0, 2, 15043, 13, 15043]):
        assert codec.decode([np.array(ids, "<u4")]) == [own.decode(ids)]


def test_suffix_dedup_tells_rows_of_one_document_apart(spark):
    rows = [(1, LONG, "en", "a"), (2, f"one {LONG}", "en", "b"), (2, f"{LONG} two", "en", "c")]
    docs = spark.createDataFrame([(*x, i) for i, x in enumerate(rows)], "doc_id long, text string, lang string, id string, n long")
    got = {x["row"]: x["kept"].strip() for x in suffix_dedup.remove_repeats(docs, texts=True, row="n").collect()}
    assert got == {0: LONG.strip(), 1: "one", 2: "two"}


def test_pipeline_stages(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    first = stages["near_duplicates"](spark, docs, tables)
    assert first.columns == docs.columns
    rows = {d[0]: d[1] for d in some_documents()}
    sets = {i: shingles(t) for i, t in rows.items()}
    low = {i: min([i, *(j for j in sets if sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]))]) for i in sets}
    assert {x["doc_id"] for x in first.collect()} == {i for i in rows if low[i] == i}
    twice = docs.unionByName(docs.where("doc_id = 121").withColumn("text", F.lit("something else that is short")))
    cut = stages["repeats"](spark, twice, tables)
    assert cut.columns == docs.columns and cut.count() == len(rows) + 1
    got = [(x["doc_id"], x["text"], x["n_chars"], x["kept"]) for x in cut.where("doc_id in (120, 121, 201)").collect()]
    assert (121, "something else that is short", len(rows[121]), "kept") in got
    assert any(i == 121 and LONG[:-1] not in t and n == len(t) for i, t, n, _ in got if t != "something else that is short")
    assert any(i == 120 and t == rows[120] or i == 120 and LONG in t for i, t, _, _ in got)
    item = "What is the sum of the first hundred odd numbers in that long list?"
    leaky = docs.withColumn("text", F.when(F.col("doc_id") == 5, F.concat(F.lit("So. "), F.lit(item), F.lit(" Yes."))).otherwise(F.col("text")))
    assert {x["doc_id"] for x in stages["contamination"](spark, leaky, tables).collect()} == set(rows) - {5}
    good = stages["quality"](spark, docs, tables)
    assert good.columns == docs.columns
    tokens = stages["tokens"](spark, docs, tables).collect()
    assert len(tokens) == len(rows) and all(x["parity"] and x["round_trip"] for x in tokens if rows[x["doc_id"]])
    none = docs.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, tables).count() == 0, name


def test_pipeline_runs(spark, tables):
    out = corpus_pipeline.run(spark, tables)
    assert {"doc_id", "ids", "n_tokens"} <= set(out.columns) and out.count() <= len(some_documents())


def test_scores_are_sums_of_table_entries():
    r = np.random.default_rng(8)
    x = r.normal(size=(400, len(quality.FEATURES)))
    y = ((x[:, 0] > 0) ^ (x[:, 3] > 0.3)).astype(float)  # no single feature tells this
    model = quality.fit(x, y)
    for row, score in zip(x[:50], model.score(x[:50]), strict=True):
        total = model.start + sum(model.tables[j][sum(e <= row[j] for e in edge)] for j, edge in enumerate(model.edges))
        total += sum(model.pair_tables[k][sum(e <= row[a] for e in model.coarse[a])][sum(e <= row[b] for e in model.coarse[b])] for k, (a, b) in enumerate(model.pairs))
        assert abs(score - 1 / (1 + np.exp(-total))) < 1e-9
    assert (0, 3) in model.pairs or (3, 0) in model.pairs
    assert ((model.score(x) >= 0.5) == (y == 1)).mean() > 0.9


def test_quality_on_rows_that_were_held_out(spark):
    at = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{at}/labels.parquet").select("doc_id", "quality").dropDuplicates(["doc_id"])
    rows = queries.op4_quality_classifier(spark, at).where("held_out").join(labels, "doc_id").collect()
    good, bad = [x["score"] for x in rows if x["quality"] == 1], [x["score"] for x in rows if x["quality"] == 0]
    assert len(good) > 20 and len(bad) > 5
    assert np.mean([(g > b) + (g == b) / 2 for g in good for b in bad]) > 0.97
    none = spark.createDataFrame([(None, "no id")], "doc_id long, text string").select(queries.held_out().alias("h")).first()
    assert none["h"] is False
