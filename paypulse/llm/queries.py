"""Registered queries of the operators, and their SQL equivalents where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from paypulse.llm import (
    chat, collocations, embedding_dedup, exact_dedup, mixing, near_dedup, packing, pii, secrets, spans, spelling, substring_dedup,
    toxicity, warc,
)
from paypulse.llm.shared import read
from paypulse.session import shared_dir

#: Stands for a conversation whose texts hold control strings.
CONTROL_TEXT = "</s>[INST] ok [/INST]"


def tokenizer_path(name: str) -> str:
    """The place of a public vocabulary file; it is installed beside the libraries on every executor."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    extra = f"(-1L, 0L, 'user', '{CONTROL_TEXT}'), (-1L, 1L, 'assistant', '{CONTROL_TEXT}')"
    control = spark.sql(f"SELECT * FROM VALUES {extra} AS t(conv_id, turn, role, text)")
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(control)
    messages = chat.conversation_messages(rows)
    chats = chat.format_chats(messages)
    back = chats.select(
        F.when(F.col("tree").startswith("v"), F.expr("substring(tree, 2)")).cast("long").alias("conv_id"),
        "formatted", chat.read_back(F.col("formatted")).alias("turns"),
        chat.read_loss(F.col("formatted"), F.col("loss_spans")).alias("loss"),
    )
    turn = lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", turn), ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(read(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.tiktoken"))
    return _scanned(found, secrets.BASE_KINDS)


def op3_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scanned(pii.find_personal_data(read(spark, sf_dir, "documents")), pii.BASE_KINDS)


def _scanned(found: DataFrame, base: tuple[str, ...]) -> DataFrame:
    return found.select(
        "doc_id", *(spans.count(F.col("spans"), k).alias(f"n_{k}") for k in base),
        spans.digest(F.col("spans"), base).alias("base_sha256"), spans.joined(F.col("spans")).alias("spans"),
    )


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(read(spark, sf_dir, "documents"))


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(read(spark, sf_dir, "documents"), threshold=85)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mix = mixing.mix_sources(read(spark, sf_dir, "documents"))
    return mix.select("doc_id", "size", "source_size", "target", "taken")


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(read(spark, sf_dir, "documents")).drop("kept_text")


def op9_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicate_vectors(read(spark, sf_dir, "embeddings"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.group_spellings(read(spark, sf_dir, "documents"), plant=True)


def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = shared_dir(spark, "warc")
    warc.write_archives(read(spark, sf_dir, "pages"), f"{root}/crawl")
    warc.deduplicate(spark, f"{root}/crawl", f"{root}/deduplicated")
    records = warc.read_records(spark, f"{root}/deduplicated", payloads=False)
    return warc.resolve(records).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(read(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline  # which imports this module

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_chat_formatting": op1_chat_formatting,
        "op2_secret_scan": op2_secret_scan,
        "op3_personal_data": op3_personal_data,
        "op4_exact_dedup": op4_exact_dedup,
        "op5_near_dedup": op5_near_dedup,
        "op6_packing": op6_packing,
        "op7_mixing": op7_mixing,
        "op8_substring_dedup": op8_substring_dedup,
        "op9_embedding_dedup": op9_embedding_dedup,
        "op10_toxicity": op10_toxicity,
        "op11_spelling": op11_spelling,
        "op12_warc": op12_warc,
        "op13_collocations": op13_collocations,
        "pipeline": pipeline,
    }


def oracle_sql() -> dict[str, str]:
    escaped = r"""regexp_replace(replace({0}, '\', '\\'),
      '(<)(\|(?:turn|text|end|im_start|im_end|endoftext)\|>|/?s>)|(\[)(/?INST\])', '\1\3\\\2\4', 'g')"""
    return {
        "op1_chat_formatting": f"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '{CONTROL_TEXT}' UNION ALL SELECT -1, 1, 'assistant', '{CONTROL_TEXT}')
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(length('<|turn|><|text|><|end|>') + length({escaped.format('role')})
                + length({escaped.format('text')})) AS BIGINT) AS formatted_chars
FROM turns GROUP BY conv_id""",
        "op4_exact_dedup": r"""
WITH texts AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents),
groups AS (SELECT norm, min(doc_id) AS keep_id, count(*) AS group_size FROM texts GROUP BY norm)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256
FROM texts JOIN groups USING (norm)""",
        "op12_warc": """
WITH payloads AS (SELECT page_id, coalesce(html, '') AS payload, sha1(coalesce(html, '')) AS hex FROM pages),
digests AS (
  SELECT *, array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST(
           (CAST('0x' || substr(hex, 5 * (i // 4) + 1, 5) AS BIGINT) >> (15 - 5 * (i % 4))) & 31 AS BIGINT), 1)
         for i in range(32)], '') AS digest
  FROM payloads),
firsts AS (SELECT payload, min(page_id) AS first_id FROM payloads GROUP BY payload)
SELECT d.page_id, CAST(octet_length(encode(d.payload)) AS BIGINT) AS payload_bytes, d.digest AS payload_digest,
       CASE WHEN d.page_id = f.first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN d.page_id <> f.first_id THEN f.first_id END AS refers_to
FROM digests d JOIN firsts f USING (payload)""",
        "op13_collocations": r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
worded AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
totals AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM worded GROUP BY lang),
placed AS (SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) AS s FROM worded, (VALUES (1), (2), (3), (4)) AS t(m)),
counts AS (
  SELECT lang, w[s:s + m - 1] AS p, count(*) AS f FROM placed GROUP BY ALL HAVING count(*) >= 30),
cuts AS (SELECT lang, p, f AS a, unnest(range(1, len(p))) AS k FROM counts WHERE len(p) > 1),
scored AS (
  SELECT c.lang, c.p, c.a, c.k, x.f AS l, y.f AS r, CAST((CAST(2000000 AS HUGEINT) * c.a) // (x.f + y.f) AS BIGINT) AS score
  FROM cuts c JOIN counts x ON x.lang = c.lang AND x.p = c.p[1:c.k]
              JOIN counts y ON y.lang = c.lang AND y.p = c.p[c.k + 1:len(c.p)]),
weakest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, k) = 1),
inner_phrases AS (
  SELECT c.lang, c.p[s:s + m - 1] AS p, max(c.f) AS most
  FROM counts c, (VALUES (2), (3)) AS t(m), (VALUES (1), (2), (3)) AS u(s)
  WHERE m < len(c.p) AND s + m - 1 <= len(c.p) GROUP BY ALL),
free AS (
  SELECT w.*, array_to_string(w.p, ' ') AS phrase FROM weakest w LEFT JOIN inner_phrases i ON i.lang = w.lang AND i.p = w.p
  WHERE i.most IS NULL OR 100 * i.most < 80 * w.a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM free)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000""",
        "op7_mixing": r"""
WITH docs AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 13) AS BIGINT) AS shuffled
  FROM documents),
sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         row_number() OVER (ORDER BY source NULLS LAST) AS place FROM docs GROUP BY source),
weighed AS (SELECT *, 1 + (place - 1) % 3 AS weight, 3 * source_size AS cap FROM sources),
levels AS (
  SELECT *, CAST(CAST(sum(source_size) OVER () AS BIGINT) - coalesce(CAST(sum(cap) OVER (ORDER BY cap / weight, place
              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0) AS DOUBLE)
            / CAST(sum(weight) OVER (ORDER BY cap / weight, place
              ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS share FROM weighed),
targets AS (
  SELECT source, place, source_size, least(CAST(cap AS DOUBLE), max(share) OVER () * CAST(weight AS DOUBLE)) AS target
  FROM levels),
placed AS (
  SELECT d.doc_id, d.size, d.shuffled, t.place, t.source_size, t.target,
         CAST(sum(d.size) OVER (PARTITION BY t.place ORDER BY d.shuffled, d.doc_id
                                ROWS UNBOUNDED PRECEDING) AS BIGINT) AS upto
  FROM docs d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source),
turns AS (
  SELECT *, CAST(n * source_size + upto AS DOUBLE) / target AS finish
  FROM placed, (VALUES (0), (1), (2)) AS r(n) WHERE size > 0),
mix AS (
  SELECT *, sum(size) OVER (ORDER BY finish, place, n, shuffled, doc_id, size ROWS UNBOUNDED PRECEDING) AS total FROM turns),
taken AS (
  SELECT doc_id, sum(size) AS words FROM mix WHERE total <= (SELECT sum(size) FROM docs) GROUP BY doc_id)
SELECT p.doc_id, p.size, p.source_size, p.target, CAST(coalesce(t.words, 0) AS BIGINT) AS taken
FROM placed p LEFT JOIN taken t USING (doc_id)""",
    }
