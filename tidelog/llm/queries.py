"""The queries op1 to op10 and the pipeline, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import audio, chat_format, decontaminate, license_scan, ngram_join, quality, sentencepiece_codec, sharding, suffix_dedup, url_filter

#: The rules of the contract of op7.
URL_RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]

#: The public model that op9 and the pipeline use; a path, never a copy in the repository.
SENTENCEPIECE_MODEL = "/opt/tokenizers/piece_bpe_32k.model"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similar_documents(table(spark, sf_dir, "documents"), k=5, percent=75)


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_rows(table(spark, sf_dir, "documents"), shards=40, overhead=16).drop("item")


def op3_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    n = F.octet_length(body)
    pad = F.when((n > 0) & (n % 576 == 0), F.lit(0)).otherwise(576 - n % 576)
    payload = F.concat(body, F.unhex(F.repeat(F.lit("FF"), pad)))
    docs = table(spark, sf_dir, "documents").select("doc_id", n.cast("long").alias("n_bytes"), payload.alias("payload"))
    # Equal texts have equal codecs: each is as good for any payload of whole ADPCM blocks.
    codec = F.element_at(F.array(*map(F.lit, ("mulaw", "alaw", "ima_adpcm"))), (F.crc32("payload") % 3 + 1).cast("int"))
    read = audio.decode_audio(audio.store_audio(docs, "payload", codec=codec, rate=8000, block=36), to_rate=16000)
    return read.select(
        "doc_id", "n_bytes", F.octet_length("samples").cast("long").alias("payload_bytes"), F.sha2("samples", 256).alias("payload_sha256"),
        F.crc32(F.substring("samples", -32, 32)).alias("tail_crc32"), F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), "feature",
        "codec", F.octet_length("pcm").cast("long").alias("pcm_bytes"), F.sha2("pcm", 256).alias("pcm_sha256"),
    )


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows that the classifier is never fitted on; a null doc_id counts as an empty text, so it isn't one."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 3 == 1


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.learn(docs, table(spark, sf_dir, "labels").where(~held_out()))
    out = quality.score_texts(docs, model)
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaked_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"), length=50)


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.url_verdicts(table(spark, sf_dir, "pages"), URL_RULES).select("page_id", "host", "path", "rule", "verdict")


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)
    out = chat_format.format_chats(turns).withColumn("turns", chat_format.read_turns(F.col("formatted"))).withColumn("loss", chat_format.read_loss(F.col("segments")))
    line = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(line, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
        "order_valid", F.col("order_error").cast("long").alias("order_error"),
    )


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sentencepiece_codec.encode_texts(table(spark, sf_dir, "documents").select("doc_id", "text"), SENTENCEPIECE_MODEL)
    return out.select("doc_id", "ids", "n_tokens", "parity", (F.col("decoded") == F.col("text")).alias("round_trip"))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(table(spark, sf_dir, "documents")).drop("n_blocks")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_ngram_join": op1_ngram_join,
        "op2_sharding": op2_sharding,
        "op3_media": op3_media,
        "op4_quality_classifier": op4_quality_classifier,
        "op5_decontaminate": op5_decontaminate,
        "op6_suffix_dedup": op6_suffix_dedup,
        "op7_url_filter": op7_url_filter,
        "op8_chat_format": op8_chat_format,
        "op9_sentencepiece": op9_sentencepiece,
        "op10_license_scan": op10_license_scan,
    }


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _op7_sql() -> str:
    rules = ", ".join(f"('{a}', '{h}', '{p}')" for a, h, p in URL_RULES)
    return f"""
    WITH rules(action, rhost, rpath) AS (VALUES {rules}),
    u AS (SELECT page_id, row_number() OVER () AS n, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) END AS rest FROM pages),
    p AS (SELECT page_id, n, coalesce(translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
      coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM u),
    hits AS (SELECT n, action, rhost || rpath AS rule, row_number() OVER (PARTITION BY n ORDER BY length(rhost || rpath) DESC, length(rhost) DESC, action DESC) AS k
      FROM p JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath))
    SELECT page_id, host, path, rule, coalesce(action, 'allow') AS verdict FROM p LEFT JOIN (SELECT * FROM hits WHERE k = 1) h USING (n)"""


def _op8_sql() -> str:
    t = chat_format.Template()
    text = "text"
    for first, rest in t.patterns:
        text = f"regexp_replace({text}, {_quoted(rf'({first})(\\*)({rest})')}, {_quoted(r'\1\\\2\3')}, 'g')"
    moves = ", ".join(_quoted(f"{a} {b}") for a, to in t.moves.items() for b in to)
    return f"""
    WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
      UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
    s AS (SELECT *, {len(t.begin) + len(t.after_role) + len(t.end)} + length(role) + length({text}) AS n,
      row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY conv_id) AS k, coalesce(lag(role) OVER w, 'start') AS before
      FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
    a AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY i) AS turns,
      coalesce(string_agg(text, '' ORDER BY i) FILTER (role = 'assistant'), '') AS loss, sum(n)::BIGINT AS formatted_chars,
      least(min(i) FILTER (before || ' ' || role NOT IN ({moves})), max(k) FILTER (i = k - 1 AND role <> 'assistant'))::BIGINT AS order_error FROM s GROUP BY conv_id)
    SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss)::BIGINT AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars, order_error IS NULL AS order_valid, order_error FROM a"""


def _op10_sql() -> str:
    phrases = ", ".join(f"({_quoted(p)}, {_quoted(x)}, {len(p.split())})" for p, x in license_scan.PHRASES.items())
    listed = lambda ws: "[" + ", ".join(map(_quoted, ws)) + "]::VARCHAR[]"
    templates = ", ".join(f"({i}, {_quoted(x)}, {listed(dict.fromkeys(license_scan._plain_words(t)))}, {listed(must)})" for i, (t, (x, must)) in enumerate(license_scan.TEMPLATES.items()))
    words = lambda x: rf"trim(regexp_replace(translate(coalesce({x}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+', ' ', 'g'))"
    return rf"""
    WITH phrases(phrase, label, k) AS (VALUES {phrases}),
    templates(t, label, ws, must) AS (VALUES {templates}),
    d AS (SELECT doc_id, text, string_split({words("text")}, ' ') AS ws, {words("text")} AS row FROM documents),
    base AS (SELECT doc_id, label, i - 1 AS pos FROM d JOIN phrases ON contains(' ' || row || ' ', ' ' || phrase || ' '), range(1, len(ws) + 1) r(i) WHERE array_to_string(ws[i:i + k - 1], ' ') = phrase),
    b AS (SELECT doc_id, count(*) AS n_base, min(pos) AS first_word, max(pos) AS last_word, list_sort(list_distinct(list(label))) AS base FROM base GROUP BY doc_id),
    blocks AS (SELECT doc_id, row_number() OVER () AS b, block FROM (SELECT doc_id, unnest(string_split(regexp_replace(text, '([.!?])[ \t\r\n]+|\n[ \t\r]*\n', '\1' || chr(10) || chr(10), 'g'), chr(10) || chr(10))) AS block FROM documents)),
    held AS (SELECT doc_id, b, list_distinct(string_split({words("block")}, ' ')) AS ws FROM blocks WHERE len(block) > 0),
    every AS (SELECT doc_id, b, label, len(t.ws) AS n, len(list_intersect(h.ws, t.ws)) / len(t.ws) AS share FROM held h, templates t
      WHERE len(h.ws) >= 0.8 * len(t.ws) - 1e-9 AND len(list_intersect(h.ws, t.ws)) >= 0.8 * len(t.ws) - 1e-9 AND len(list_intersect(t.must, h.ws)) = len(t.must)),
    hits AS (SELECT doc_id, label, share FROM (SELECT *, rank() OVER (PARTITION BY b ORDER BY share DESC, n DESC) AS k FROM every) WHERE k = 1),
    m AS (SELECT doc_id, max(share) AS share, list(DISTINCT label) AS labels FROM hits GROUP BY doc_id)
    SELECT doc_id, CASE WHEN row = '' THEN 0 ELSE len(ws) END::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
      coalesce(array_to_string(base, ','), '') AS base_labels, coalesce(array_to_string(list_sort(list_distinct(list_concat(base, labels))), ','), '') AS labels,
      CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(share, 0.0)::DOUBLE END AS score
    FROM d LEFT JOIN b USING (doc_id) LEFT JOIN m USING (doc_id)"""


OP1_SQL = r"""
    WITH RECURSIVE d AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS ws FROM documents),
    s AS (SELECT DISTINCT doc_id, hash(CASE WHEN len(ws) < 5 THEN array_to_string(ws, ' ') ELSE array_to_string(ws[i:i + 4], ' ') END) AS h FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM d WHERE len(ws) > 0)),
    n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
    o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.h = b.h AND a.doc_id <> b.doc_id GROUP BY ALL),
    l AS (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
    r(doc_id, c) AS (SELECT doc_id, doc_id FROM documents UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.doc_id WHERE r.c < l.b)
    SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id FROM (SELECT doc_id, min(c) AS component_id FROM r GROUP BY doc_id) LEFT JOIN n USING (doc_id)"""


def oracle_sql() -> dict[str, str]:
    return {"op1_ngram_join": OP1_SQL, "op7_url_filter": _op7_sql(), "op8_chat_format": _op8_sql(), "op10_license_scan": _op10_sql()}
