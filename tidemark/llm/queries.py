"""One registered query per operator, and the SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import chat, collocations, fingerprint, langid, lexical, linededup, mixing, nearest, ngramjoin, personal, pieces, quality, tokencount

LLM_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
LLM_ORACLES: dict[str, str] = {}


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op5_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest vectors found of every vector whose id is divisible by 100."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return nearest.nearest(vectors, vectors.where(F.col("vec_id") % 100 == 0), k=10)


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and tokens of every document by the word-level vocabulary."""
    return tokencount.count_tokens(_documents(spark, sf_dir), tokencount.tokenizer_path("word_bpe_49k.json"))


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and its edited text, and how alike they are."""
    return fingerprint.fingerprint_documents(_documents(spark, sf_dir))


def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents that link at a Jaccard likeness of 0.85 of their 4-word shingles."""
    return ngramjoin.ngram_components(_documents(spark, sf_dir), k=4, percent=85)


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How likely `labels.quality` would mark each document 1."""
    return quality.quality_scores(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op2_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's tokens, and whether they decode to its text (in which U+2581 and the space are one)."""
    sha = F.sha2(F.replace(F.coalesce("text", F.lit("")), F.lit("\u2581"), F.lit(" ")), 256)
    encoded = pieces.encode(_documents(spark, sf_dir).select("doc_id", "text", sha.alias("sha"))).drop("text")
    decoded = pieces.decode(encoded).withColumn("decoded_sha256", F.sha2("decoded", 256))
    return decoded.select("doc_id", F.size("tokens").cast("long").alias("n_tokens"), "tokens", "decoded_sha256", (F.col("decoded_sha256") == F.col("sha")).alias("same_text"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document by code length."""
    return langid.identify(_documents(spark, sf_dir))


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words the mix takes of every document."""
    mixed = mixing.mix(_documents(spark, sf_dir))
    return mixed.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken", "source")


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document's lines."""
    left = linededup.dedup_lines(_documents(spark, sf_dir).select("doc_id", "text"))
    return left.select("doc_id", "lines", "lines_dropped", "has_text", F.sha2("text", 256).alias("text_sha256"))


LLM_ORACLES["op8_ngram_join"] = r"""
WITH RECURSIVE w AS (
    SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), s AS (
    SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
        ELSE list_transform(range(1, len(ws) - 2), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] || ' ' || ws[i + 3]) END) AS g FROM w
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1
), p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b USING (g) WHERE a.doc_id < b.doc_id GROUP BY 1, 2
), l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 85 * (x.n + y.n - i)
), e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l
), r(doc_id, root) AS (SELECT doc_id, doc_id FROM documents UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.doc_id)
SELECT doc_id, coalesce(n, 0) AS n_shingles, min(root) AS component_id FROM r LEFT JOIN n USING (doc_id) GROUP BY 1, 2
"""

LLM_ORACLES["op9_line_dedup"] = r"""
WITH t AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents
), l AS (SELECT doc_id, i AS place, ls[i] AS line, regexp_extract_all(ls[i], '[^\x20\x09-\x0D]+') AS ws FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM t)
), o AS (SELECT *, len(ws) AS n, array_to_string(ws, ' ') AS k, row_number() OVER (ORDER BY doc_id, place) AS pos FROM l
), c AS (SELECT k, n, any_value(ws) AS ws, min(pos) AS first FROM o WHERE n >= 2 GROUP BY 1, 2
), d AS (SELECT k, first, i AS gone, array_to_string(list_concat(ws[1:i - 1], ws[i + 1:]), ' ') AS rest FROM (SELECT *, unnest(range(1, n + 1)) AS i FROM c WHERE n >= 10)
), near AS (
    SELECT k FROM (SELECT k, first, min(first) OVER (PARTITION BY rest, gone) AS m FROM d) WHERE m < first
    UNION SELECT d.k FROM d JOIN c ON c.k = d.rest AND c.n >= 10 WHERE c.first < d.first
    UNION SELECT c.k FROM d JOIN c ON c.k = d.rest AND c.n >= 10 WHERE d.first < c.first
), marked AS (
    SELECT o.*, o.n < 2 OR (o.pos = c.first AND near.k IS NULL) AS kept FROM o LEFT JOIN c ON c.k = o.k AND o.n >= 2 LEFT JOIN near ON near.k = c.k
)
SELECT doc_id, count(*) AS lines, count(*) FILTER (NOT kept) AS lines_dropped, coalesce(bool_or(kept AND n > 0), false) AS has_text,
    sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (kept), '')) AS text_sha256
FROM marked GROUP BY doc_id
"""

PROBE = "</s>[INST] ok [/INST]"


def op10_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and one that says control strings, read back from their formatted windows."""
    columns = ["conv_id", "turn", "role", "text"]
    probe = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PROBE).alias("text")
    )
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select(*columns).unionByName(probe)
    return chat.digests(chat.format_windows(turns))


LLM_ORACLES["op10_chat_windows"] = r"""
WITH said AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), counted AS (
    SELECT *, len(regexp_extract_all(text, '[A-Za-z0-9_]+|[^A-Za-z0-9_\x20\x09-\x0D]')) + 4 AS tokens,
        row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS place FROM said
), placed AS (
    SELECT *, coalesce(sum(tokens) OVER (PARTITION BY conv_id ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS begins,
        place = 1 AND role = 'system' AS is_system, max(CASE WHEN place = 1 AND role = 'system' THEN tokens ELSE 0 END) OVER (PARTITION BY conv_id) AS system_tokens FROM counted
), cut AS (
    SELECT *, floor(begins / greatest(128, floor((896 - system_tokens) / 2)))::BIGINT AS win FROM placed
), opened AS (SELECT conv_id, win, min(begins) AS opens FROM cut GROUP BY ALL
), followed AS (SELECT *, lead(opens) OVER (PARTITION BY conv_id ORDER BY win) AS next_opens, count(*) OVER (PARTITION BY conv_id) AS wins FROM opened
), sized AS (
    SELECT c.*, length(replace(replace(replace(replace(role, '&', '&amp;'), '<', '&lt;'), '[', '&#91;'), chr(10), '&#10;'))
        + length(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '[', '&#91;')) + 1 + 8 AS chars,
        CASE WHEN is_system THEN wins - 1 WHEN next_opens - begins <= 128 THEN 1 ELSE 0 END AS repeats
    FROM cut c JOIN followed f ON c.conv_id IS NOT DISTINCT FROM f.conv_id AND c.win = f.win
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY place)) AS turns_sha256,
    coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY place) FILTER (role = 'assistant'), '')) AS loss_sha256,
    sum(chars + 8 + repeats * (chars + 10))::BIGINT AS formatted_chars
FROM sized GROUP BY conv_id
"""


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 2,000 phrases of every language."""
    return collocations.collocations(_documents(spark, sf_dir), k=2000, least=30)


LLM_ORACLES["op11_collocations"] = r"""
WITH pieces AS (
    SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
), words AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM pieces
), grams AS (SELECT lang, m, unnest(list_transform(range(1, len(ws) - m + 2), lambda i: array_to_string(ws[i:i + m - 1], ' '))) AS phrase FROM words, range(1, 5) t(m)
), f AS (SELECT lang, m, phrase, count(*) AS f FROM grams GROUP BY ALL
), totals AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE m = 1 GROUP BY 1
), often AS (SELECT *, string_split(phrase, ' ') AS ws FROM f WHERE m > 1 AND f >= 30
), held AS (
    SELECT lang, part AS phrase, max(f) AS held FROM (
        SELECT lang, f, unnest(list_transform(range(1, m - size + 2), lambda i: array_to_string(ws[i:i + size - 1], ' '))) AS part FROM often, range(2, 4) t(size) WHERE size < m
    ) GROUP BY 1, 2
), cuts AS (
    SELECT o.lang, o.phrase, o.f AS a, k, x.f AS l, y.f AS r, (2000000::HUGEINT * o.f) // (x.f + y.f) AS score
    FROM often o JOIN range(1, 4) t(k) ON k < o.m
    JOIN f x ON x.lang = o.lang AND x.phrase = array_to_string(o.ws[1:k], ' ') JOIN f y ON y.lang = o.lang AND y.phrase = array_to_string(o.ws[k + 1:], ' ')
    LEFT JOIN held h ON h.lang = o.lang AND h.phrase = o.phrase WHERE h.held IS NULL OR 100::HUGEINT * h.held < 80::HUGEINT * o.f
), lowest AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM lowest)
SELECT lang, rank, phrase, a, l, r, n, score::BIGINT AS score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""


def op12_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document, by pattern and by the field learned from the documents."""
    return personal.find_personal_data(_documents(spark, sf_dir))


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best documents of every benchmark item."""
    return lexical.rank_documents(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), k=20)


LLM_ORACLES["op13_ranked_search"] = r"""
WITH terms AS (
    SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents
), tf AS (SELECT doc_id, term, count(*)::BIGINT AS tf FROM terms GROUP BY 1, 2
), sizes AS (SELECT doc_id, count(*)::BIGINT AS n FROM terms GROUP BY 1
), totals AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS said FROM sizes
), lengths AS (SELECT doc_id, 75 + (25 * n * docs) // said AS m FROM sizes, totals
), weights AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS w FROM (SELECT term, count(*) AS df FROM tf GROUP BY 1), totals
), asked AS (
    SELECT item_id, term, count(*)::BIGINT AS times FROM (
        SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark
    ) GROUP BY 1, 2
), scored AS (
    SELECT item_id, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * m)))::BIGINT AS score
    FROM asked JOIN tf USING (term) JOIN weights USING (term) JOIN lengths USING (doc_id) GROUP BY 1, 2
), ranked AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM ranked WHERE rank <= 20
"""


for _query in (op1_quality, op2_sentence_pieces, op3_language_id, op4_mix_sources, op5_nearest, op6_token_counts, op7_fingerprints, op8_ngram_join, op9_line_dedup, op10_chat_windows, op11_collocations, op12_personal_data, op13_ranked_search):
    LLM_QUERIES[_query.__name__] = _query
