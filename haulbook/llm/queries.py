"""The queries of the operators: each applies one with its production parameters to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from haulbook.llm import (
    attention_quality,
    ball_codes,
    chat_repair,
    collision_search,
    collocations,
    context_tree,
    mixing,
    norm_search,
    piece_transducer,
    pii_crf,
    quality_rules,
    simhash,
    site_templates,
)
from haulbook.llm.common import prepare, table

#: The model that texts are encoded with; a path on the driver, whose content is sent to the executors.
PIECE_MODEL = "/opt/tokenizers/piece_bpe_32k.model"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(function: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: function(prepare(spark), sf_dir)
        if sql is not None:
            SQL[name] = sql
        return function

    return register


#: What the cascade decides, in DuckDB's SQL. ``w``: words, ``c``: windows with their counts.
QUALITY_SQL = r"""
WITH texts AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
worded AS (SELECT row_number() OVER () AS id, doc_id, text,
                  list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM texts),
windows AS (SELECT id, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c
            FROM (SELECT id, w, unnest(range(1, len(w) - 1)) AS i FROM worded)),
repeats AS (SELECT id, i FROM windows QUALIFY count(*) OVER (PARTITION BY id, a, b, c) > 1),
covered AS (SELECT id, count(DISTINCT p) AS n FROM (SELECT id, unnest([i, i + 1, i + 2]) AS p FROM repeats) GROUP BY id),
measured AS (
  SELECT doc_id, text, w, cast(len(w) AS BIGINT) AS n_words,
         cast(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
         cast(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l,
         coalesce(n, 0) AS n_repeat_words
  FROM worded LEFT JOIN covered USING (id)),
judged AS (SELECT *, cast(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
                  n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM measured)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR 10 * n_symbols > 3 * n_words
         OR 2 * length(regexp_replace(text, '[^\p{Lu}]', '', 'g')) > word_chars
         OR 2 * len(regexp_extract_all(text, '[!?]{2,}')) > n_words
         OR 2 * length(regexp_replace(text, '[^0-9]', '', 'g')) > word_chars
         OR word_chars > 20 * n_words OR word_chars < 2 * n_words
         OR 20 * len(list_distinct(w)) < least(n_words, 2000)
         OR 10 * n_dup_lines > 4 * len(l)) AS kept
FROM judged
"""


@query("op10_quality_rules", QUALITY_SQL)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cascade of quality rules over all documents."""
    return quality_rules.judge(table(spark, sf_dir, "documents")).select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        "kept",
    )


@query("op1_simhash")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints and near-duplicate components of all documents."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


@query("op7_pieces")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of all documents and the texts decoded from them."""
    found = piece_transducer.with_ids(table(spark, sf_dir, "documents"), PIECE_MODEL)
    return found.select("doc_id", "ids", "n_ids", "decoded", "round_trip")


@query("op9_pii")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in all documents."""
    return pii_crf.with_spans(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"
    )


#: Weights of the query's tree. The table has no domains; each source belongs to one of four by its name's checksum.
MIX_WEIGHTS = {"lang": {"en": 4.0, "de": 2.0, "fr": 2.0, "es": 2.0}, "domain": {"d0": 1.0, "d1": 2.0, "d2": 3.0, "d3": 2.0}}


def domain_of(source: Column) -> Column:
    checksum = F.crc32(F.coalesce(source, F.lit("")).cast("binary")) % 4
    return F.concat(F.lit("d"), checksum.cast("string"))


@query("op5_mixing")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half of all tokens, by weight, from all documents."""
    docs = table(spark, sf_dir, "documents").withColumn("domain", domain_of(F.col("source")))
    return mixing.mix(docs, weights=MIX_WEIGHTS).select("doc_id", "domain", "lang", "source", "tokens", "epoch")


@query("op8_main_text")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of all pages."""
    return site_templates.with_main_text(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


NEAREST_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: cast(floor(256 * cast(x AS DOUBLE)) AS DOUBLE)) AS e
           FROM embeddings WHERE len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (SELECT q.vec_id AS query_id, c.vec_id, cast(list_dot_product(q.e, c.e) AS BIGINT) AS score
           FROM v AS q JOIN v AS c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id)
SELECT query_id, cast(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM scored QUALIFY rank <= 5
"""


@query("op6_nearest", NEAREST_SQL)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best inner products of every fiftieth vector among all others."""
    return norm_search.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


@query("op2_chat_format")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations repaired and rendered."""
    return chat_repair.format_chats(table(spark, sf_dir, "conversations"))


@query("op3_context_tree")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base and context-tree score of all documents."""
    return context_tree.score_documents(table(spark, sf_dir, "documents"))


@query("op4_attention_quality")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of all documents."""
    found = attention_quality.with_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select("doc_id", "held_out", "score", "predicted")


def codes_sql(entries: int = 64, parts: int = 16, rounds: int = 2) -> str:
    """Assignments and means of every round written out. ``x``: parts, ``b0`` ...: codebooks, ``a0`` ...: assignments."""
    square = "list_dot_product({0}, {0})"
    steps = []
    for number in range(rounds + 1):
        if number:
            steps.append(f"""
m{number} AS (SELECT p, e, list(floor(s / n) ORDER BY j) AS c FROM
        (SELECT p, e, j, sum(x[j]) AS s, count(*) AS n FROM a{number - 1}, range(1, 65) AS t(j) WHERE j <= len(x) GROUP BY p, e, j)
      GROUP BY p, e),
b{number} AS (SELECT p, e, coalesce(m{number}.c, b{number - 1}.c) AS c FROM b{number - 1} LEFT JOIN m{number} USING (p, e))""")
        steps.append(f"""
a{number} AS (SELECT row, p, x, e, d FROM (
        SELECT row, p, x, e, {square.format('x')} - 2 * list_dot_product(x, c) + {square.format('c')} AS d
        FROM x JOIN b{number} USING (p)) QUALIFY row_number() OVER (PARTITION BY row, p ORDER BY d, e) = 1)""")
    last = rounds
    return f"""
WITH v AS (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST) AS row, vec_id, label, v FROM (
  SELECT vec_id, label, list_transform(embedding, lambda x: floor(256 * cast(x AS DOUBLE))) AS v FROM embeddings
  WHERE len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)),
x AS (SELECT row, p, v[p * len(v) // {parts} + 1 : (p + 1) * len(v) // {parts}] AS x FROM v, range({parts}) AS t(p)),
b0 AS (SELECT p, row - 1 AS e, x AS c FROM x WHERE row <= {entries}),{",".join(steps)},
coded AS (SELECT row, string_agg(printf('%02x', e), '' ORDER BY p) AS code, cast(sum(d) AS BIGINT) AS error FROM a{last} GROUP BY row),
book AS (SELECT sha256(string_agg(array_to_string(list_transform(c, lambda y: cast(cast(y AS BIGINT) AS VARCHAR)), ','), ',' ORDER BY p, e))
         AS codebooks_sha256 FROM b{last})
SELECT vec_id, code, error, cast(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
FROM coded JOIN v USING (row), book
"""


@query("op12_vector_codes", codes_sql())
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of all vectors."""
    return ball_codes.encode(table(spark, sf_dir, "embeddings"))


@query("op13_collision_search")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest found of every fiftieth vector among all others."""
    return collision_search.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


COLLOCATIONS_SQL = r"""
WITH pieces AS (
  SELECT row_number() OVER () AS piece, lang, p FROM (
    SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
             translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?
-
]')) AS p
    FROM documents)),
worded AS (SELECT lang, list_filter(regexp_split_to_array(p, '[ 	]+'), lambda x: x <> '') AS w FROM pieces),
spots AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM worded),
totals AS (SELECT lang, count(*) AS n FROM spots GROUP BY lang),
f AS (SELECT lang, k, array_to_string(w[i : i + k - 1], ' ') AS phrase, count(*) AS f
      FROM spots, range(1, 5) AS t(k) WHERE i + k - 1 <= len(w) GROUP BY ALL HAVING count(*) >= 30),
c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1),
split AS (SELECT lang, k, phrase, a, cut, array_to_string(w[: cut], ' ') AS p, array_to_string(w[cut + 1 :], ' ') AS q
          FROM c, range(1, 4) AS t(cut) WHERE cut < k),
cuts AS (SELECT split.*, l.f AS l, r.f AS r, cast((2000000 * cast(a AS HUGEINT)) // (l.f + r.f) AS BIGINT) AS score
         FROM split JOIN f AS l ON (split.lang, p) = (l.lang, l.phrase) JOIN f AS r ON (split.lang, q) = (r.lang, r.phrase)),
low AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
inner_parts AS (SELECT lang, array_to_string(w[i : i + m - 1], ' ') AS phrase, max(a) AS longer
                FROM c, range(2, 4) AS t(m), range(1, 4) AS u(i) WHERE m < k AND i + m - 1 <= k GROUP BY ALL)
SELECT low.lang, row_number() OVER (PARTITION BY low.lang ORDER BY score DESC, a DESC, encode(low.phrase)) AS rank,
       low.phrase, a, l, r, cast(n AS BIGINT) AS n, score
FROM low JOIN totals USING (lang) LEFT JOIN inner_parts USING (lang, phrase)
WHERE longer IS NULL OR 100 * longer < 80 * a
QUALIFY rank <= 2000
"""


@query("op11_collocations", COLLOCATIONS_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best 2000 collocations of each language in all documents."""
    return collocations.mine(table(spark, sf_dir, "documents"))
