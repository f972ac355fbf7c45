"""The operators of this subpackage over whole tables, one query each."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import (bitsliced, bpe, centroids, chat, langid, licenses, line_dedup, minhash_forest, packing, pq,
               sharding, suffix_dedup, whitening)
from .common import cut_lineage

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

RANKS = "byte_bpe_50k.tiktoken"


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(probe).alias("text"))
    rows = turns.unionByName(extra).select("conv_id", "turn", "role",
                                           chat.text_part(F.col("text")).alias("parts"))
    read = chat.format_chats(rows).select(
        "conv_id", "formatted", chat.read_turns(F.col("formatted")).alias("turns"),
        chat.learned_text(F.col("formatted"), F.col("loss")).alias("learned"))
    told = F.array_join(F.transform("turns", lambda t: F.concat(
        t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"),
        F.sha2(told.cast("binary"), 256).alias("turns_sha256"),
        F.length("learned").cast("long").alias("loss_chars"),
        F.sha2(F.col("learned").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"))


_ESCAPES = r"<\\*(?:\||s>|/s>|<SYS>>|</SYS>>)|\[\\*(?:INST\]|/INST\])"
ORACLES["op1_chat_formatting"] = rf"""
    WITH turns AS (
        SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text
        FROM conversations
        UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
        UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
    ), told AS (
        SELECT conv_id, count(*) AS n_turns,
               string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS told,
               coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, ''
                        ORDER BY turn NULLS FIRST, role, text), '') AS learned,
               sum(23 + length(role) + length(text)
                   + len(regexp_extract_all(role, '{_ESCAPES}'))
                   + len(regexp_extract_all(text, '{_ESCAPES}')))::BIGINT AS formatted_chars
        FROM turns GROUP BY conv_id
    )
    SELECT conv_id, n_turns, sha256(told) AS turns_sha256, length(learned)::BIGINT AS loss_chars,
           sha256(learned) AS loss_sha256, formatted_chars
    FROM told"""


@query
def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sharding.assign(_table(spark, sf_dir, "documents"), 24)
    return rows.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot",
                       "grown_shard")


@query
def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path(RANKS)
    encoded = bpe.encode(_table(spark, sf_dir, "documents"), path)
    ids = F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")).cast("binary"), 256)
    return bpe.decode(
        encoded.withColumn("key", F.struct("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                                           ids.alias("ids_sha256"))), path, "key",
    ).select("key.doc_id", "key.n_tokens", "key.ids_sha256",
             F.sha2("decoded", 256).alias("decoded_sha256"))


@query
def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = line_dedup.apply(docs, line_dedup.build(docs))
    return rows.select("doc_id", "n_lines", "n_dropped",
                       F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


_BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_KEY = f"translate(trim(line, {_BLANKS}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
ORACLES["op2_line_dedup"] = f"""
    WITH split AS (
        SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents
    ), lines AS (
        SELECT doc_id, generate_subscripts(lines, 1) AS place, unnest(lines) AS line FROM split
    ), keyed AS (SELECT doc_id, place, line, {_KEY} AS key FROM lines),
    repeated AS (
        SELECT key, max(doc_id) AS top FROM keyed WHERE length(key) >= 40
        GROUP BY key HAVING count(DISTINCT doc_id) >= 5
    ), marked AS (
        SELECT k.doc_id, place, line, top IS NOT NULL AND top <> k.doc_id AS dropped
        FROM keyed k LEFT JOIN repeated USING (key)
    )
    SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE dropped) AS n_dropped,
           sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (WHERE NOT dropped), '')) AS kept_sha256
    FROM marked GROUP BY doc_id"""


@query
def op7_bit_sliced_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bitsliced.top_k(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


ORACLES["op7_bit_sliced_top_k"] = """
    WITH v AS (
        SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v
        FROM embeddings
        WHERE embedding IS NOT NULL AND list_count(embedding) = len(embedding)
          AND len(list_filter(embedding, lambda x: NOT isfinite(x))) = 0
    ), scored AS (
        SELECT q.vec_id AS query_id, c.vec_id,
               list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::BIGINT AS score
        FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0
    ), ranked AS (
        SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank,
               vec_id, score FROM scored
    )
    SELECT * FROM ranked WHERE rank <= 10"""


def held_out(key: str = "doc_id"):
    return F.crc32(F.col(key).cast("string").cast("binary")) % 4 == 2


@query
def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.fit(docs.where(~held_out()))
    return langid.predict(docs, model).select(
        "doc_id", held_out().alias("held_out"), "lang_pred", "score")


@query
def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.json")
    cut = packing.pieces(_table(spark, sf_dir, "documents"), path)
    cut = cut_lineage(cut.withColumn("ids_crc32", F.crc32("ids")).drop("ids"))
    return packing.pack(cut).select("doc_id", "piece", "start", "length", "ids_crc32",
                                    "sequence_id", "offset")


@query
def op9_product_quantised_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pq.near_duplicates(_table(spark, sf_dir, "embeddings"))


@query
def op10_minhash_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return minhash_forest.near_duplicates(docs, words=3, percent=85)


@query
def op5_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = suffix_dedup.remove_repeats(_table(spark, sf_dir, "documents"), 100)
    return rows.select("doc_id", "n_bytes", "n_removed", "n_spans",
                       F.sha2("kept", 256).alias("kept_sha256"))


# Reachability for the small tables that oracles run on; the operators use star rounds instead.
_REACH = """reach AS (
        SELECT a AS node, a AS seen FROM links
        UNION SELECT node, b FROM reach JOIN links ON seen = a
    ), smallest AS (SELECT node, min(seen) AS component_id FROM reach GROUP BY node)"""

ORACLES["op9_product_quantised_dedup"] = f"""
    WITH RECURSIVE v AS (
        SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS x FROM embeddings
        WHERE embedding IS NOT NULL AND label IS NOT NULL AND list_count(embedding) = len(embedding)
          AND len(list_filter(embedding, lambda x: NOT isfinite(x))) = 0
          AND len(list_filter(embedding, lambda x: x <> 0)) > 0
    ), links AS (
        SELECT p.vec_id AS a, q.vec_id AS b FROM v p JOIN v q
        ON p.label = q.label AND p.vec_id <> q.vec_id AND len(p.x) = len(q.x)
        WHERE list_cosine_similarity(p.x, q.x) >= 0.93
    ), {_REACH}
    SELECT vec_id, (SELECT count(*) FROM links WHERE a = vec_id) AS n_links,
           coalesce(component_id, vec_id) AS component_id,
           coalesce(component_id, vec_id) = vec_id AS kept
    FROM embeddings LEFT JOIN smallest ON node = vec_id"""

ORACLES["op10_minhash_forest"] = rf"""
    WITH RECURSIVE words AS (
        SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
               'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
    ), shingled AS (
        SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN []
               WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
               ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])
               END) AS s FROM words
    ), posted AS (SELECT doc_id, unnest(s) AS shingle FROM shingled),
    shared AS (
        SELECT p.doc_id AS a, q.doc_id AS b, count(*) AS n FROM posted p JOIN posted q
        ON p.shingle = q.shingle AND p.doc_id <> q.doc_id GROUP BY 1, 2
    ), links AS (
        SELECT a, b FROM shared JOIN shingled p ON p.doc_id = a JOIN shingled q ON q.doc_id = b
        WHERE 100 * n >= 85 * (len(p.s) + len(q.s) - n)
    ), {_REACH}
    SELECT doc_id, len(s)::BIGINT AS n_shingles, coalesce(component_id, doc_id) AS component_id,
           coalesce(component_id, doc_id) = doc_id AS kept
    FROM shingled LEFT JOIN smallest ON node = doc_id"""

# Bytes as pairs of hexadecimal digits: place k of a text is digits 2k + 1 and 2k + 2.
ORACLES["op5_suffix_array_dedup"] = """
    WITH texts AS (
        SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, strlen(coalesce(text, ''))::BIGINT AS n
        FROM documents
    ), strings AS (
        SELECT doc_id, k, substr(h, 2 * k + 1, 200) AS s
        FROM (SELECT doc_id, h, unnest(range(0, n - 99)) AS k FROM texts)
    ), again AS (
        SELECT doc_id, k FROM strings
        QUALIFY row_number() OVER (PARTITION BY s ORDER BY doc_id, k) > 1
    ), marked AS (
        SELECT doc_id, k, CASE WHEN k <= lag(k) OVER (PARTITION BY doc_id ORDER BY k) + 100
                               THEN 0 ELSE 1 END AS opens FROM again
    ), spans AS (
        SELECT doc_id, min(k) AS a, max(k) + 100 AS b
        FROM (SELECT doc_id, k, sum(opens) OVER (PARTITION BY doc_id ORDER BY k) AS span FROM marked)
        GROUP BY doc_id, span
    ), pieces AS (
        SELECT doc_id, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS since, a AS upto
        FROM (SELECT * FROM spans UNION ALL SELECT doc_id, n, n FROM texts)
    ), kept AS (
        SELECT doc_id, string_agg(substr(h, (2 * since + 1)::BIGINT, (2 * (upto - since))::BIGINT), ''
               ORDER BY since) AS kept FROM pieces JOIN texts USING (doc_id) GROUP BY doc_id
    ), removed AS (
        SELECT doc_id, sum(b - a)::BIGINT AS n_removed, count(*) AS n_spans FROM spans GROUP BY doc_id
    )
    SELECT doc_id, n AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
           sha256(unhex(kept)) AS kept_sha256
    FROM texts JOIN kept USING (doc_id) LEFT JOIN removed USING (doc_id)"""


@query
def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(_table(spark, sf_dir, "embeddings"))


def _clustering_sql(k: int = 8, rounds: int = 10, seed: int = 3) -> str:
    """The rounds written out one after the other."""
    steps = [f"""kept AS (
        SELECT row_number() OVER () AS line, vec_id,
               list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v
        FROM embeddings
        WHERE len(embedding) = 64 AND list_count(embedding) = 64
          AND len(list_filter(embedding, lambda x: NOT isfinite(x))) = 0
    ), long AS (
        SELECT line, unnest(range(64)) AS d, unnest(v) AS x FROM kept
    ), first AS (
        SELECT row_number() OVER (ORDER BY sha256('{seed}:' || vec_id), v) - 1 AS cluster, v
        FROM kept WHERE vec_id IS NOT NULL
    ), c0 AS (
        SELECT cluster, unnest(range(64)) AS d, unnest(v) AS x FROM first WHERE cluster < {k}
    )"""]
    for r in range(rounds + 1):
        steps.append(f"""a{r} AS MATERIALIZED (
        SELECT line, min({{'distance': distance, 'cluster': cluster}}) AS best FROM (
            SELECT line, cluster, sum((l.x - c.x) * (l.x - c.x))::BIGINT AS distance
            FROM long l JOIN c{r} c USING (d) GROUP BY line, cluster) GROUP BY line)""")
        if r < rounds:
            steps.append(f"""c{r + 1} AS MATERIALIZED (
        SELECT c.cluster, c.d, coalesce(m.x, c.x) AS x FROM c{r} c LEFT JOIN (
            SELECT a.best.cluster AS cluster, d,
                   ((sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*))::BIGINT AS x
            FROM long JOIN a{r} a USING (line) GROUP BY a.best.cluster, d) m USING (cluster, d))""")
    return f"""
    WITH {", ".join(steps)}, digests AS (
        SELECT cluster, sha256(string_agg(x, ',' ORDER BY d)) AS centroid_sha256 FROM c{rounds} GROUP BY cluster
    )
    SELECT vec_id, best.cluster::INTEGER AS cluster, best.distance AS distance,
           sum(best.distance) OVER (PARTITION BY best.cluster)::BIGINT AS cluster_inertia,
           sum(best.distance) OVER ()::BIGINT AS inertia, centroid_sha256
    FROM kept JOIN a{rounds} USING (line) JOIN digests ON digests.cluster = best.cluster"""


ORACLES["op11_centroid_clustering"] = _clustering_sql()


@query
def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    model = whitening.fit(vectors, components=32)
    errors = whitening.identity_errors(vectors, model)
    # One number over all widths; a table has one width as a rule.
    error = F.lit(max(errors.values(), default=0.0))
    return whitening.transform(vectors, model).drop("width").withColumn("identity_error", error)


@query
def op12_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = licenses.scan(_table(spark, sf_dir, "documents"))
    starts = F.flatten(F.transform("base", lambda b: b["starts"]))
    base = F.transform(F.filter("base", lambda b: F.size(b["starts"]) > 0), lambda b: b["label"])
    found = F.transform("finds", lambda f: f["label"])
    joined = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    return rows.select(
        "doc_id", "n_words", F.size(starts).cast("long").alias("n_base"),
        F.array_min(starts).cast("long").alias("first_word"),
        F.array_max(starts).cast("long").alias("last_word"), joined(base).alias("base_labels"),
        joined(F.concat(base, found)).alias("labels"),
        F.coalesce(F.array_max(F.transform("finds", lambda f: f["score"])),
                   F.when(F.size(starts) > 0, 0.5).otherwise(0.0)).alias("score"))


def _licence_sql() -> str:
    """The index as a table of values; each step as a join."""
    listed = lambda rows: ", ".join(str(r) for r in rows)
    words = licenses.vocabulary()
    notices = [(n, label, len(phrase.split()), phrase, licenses._anchor(n))
               for n, (label, phrase, _) in enumerate(licenses.NOTICES)]
    return f"""
    WITH words AS (
        SELECT row_number() OVER () AS line, doc_id,
               regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                   'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
    ), placed AS (
        SELECT line, unnest(range(len(w))) AS p, unnest(w) AS word,
               unnest(list_concat(w[2:], [''])) AS word2, unnest(list_concat(w[3:], ['', ''])) AS word3 FROM words
    ), licence(n, word) AS (VALUES {listed(enumerate(words))}),
    posting(n, notice, place) AS (VALUES {listed(licenses.index())}),
    notice(notice, label, size, phrase, anchor) AS (VALUES {listed(notices)}),
    base(phrase, label) AS (VALUES {listed(licenses.BASE.items())}),
    hits AS (SELECT line, n, p FROM placed JOIN licence USING (word)),
    spoken AS (
        SELECT line, p, word || ' ' || word2 AS phrase FROM placed
        UNION ALL SELECT line, p, word || ' ' || word2 || ' ' || word3 FROM placed
    ), plain AS (SELECT line, p, label FROM spoken JOIN base USING (phrase)),
    weight AS (SELECT n, count(DISTINCT line) AS texts FROM hits GROUP BY n),
    rare AS (
        SELECT line, n FROM (SELECT DISTINCT line, n FROM hits WHERE n IN (SELECT n FROM posting))
        JOIN weight USING (n)
        QUALIFY row_number() OVER (PARTITION BY line ORDER BY texts, n) <= {licenses.LOOKED_UP}
    ), asked AS (
        SELECT line, notice, count(DISTINCT n) AS asked FROM rare JOIN posting USING (n) GROUP BY line, notice
    ), agreed AS (
        SELECT line, notice, p - place AS start, count(DISTINCT n) AS agreeing
        FROM hits JOIN rare USING (line, n) JOIN posting USING (n) GROUP BY line, notice, p - place
    ), finds AS (
        SELECT line, label, agreeing / asked AS score
        FROM agreed JOIN asked USING (line, notice) JOIN notice USING (notice)
        WHERE agreeing >= {licenses.LEAST_AGREE} AND 2 * agreeing >= asked AND EXISTS (
            SELECT 1 FROM spoken s WHERE s.line = agreed.line AND s.phrase = notice.phrase
            AND abs(s.p - start - anchor) <= {licenses.SLACK})
    ), plainly AS (
        SELECT line, count(*) AS n_base, min(p)::BIGINT AS first_word, max(p)::BIGINT AS last_word,
               string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM plain GROUP BY line
    ), named AS (
        SELECT line, string_agg(DISTINCT label, ',' ORDER BY label) AS labels
        FROM (SELECT line, label FROM plain UNION SELECT line, label FROM finds) GROUP BY line
    ), best AS (SELECT line, max(score) AS score FROM finds GROUP BY line)
    SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
           coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
           coalesce(score, CASE WHEN n_base > 0 THEN 0.5 ELSE 0.0 END)::DOUBLE AS score
    FROM words LEFT JOIN plainly USING (line) LEFT JOIN named USING (line) LEFT JOIN best USING (line)"""


ORACLES["op12_license_scan"] = _licence_sql()
