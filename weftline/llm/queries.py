"""Registered queries of the training-data operators and their SQL counterparts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.ctw import score_texts
from weftline.llm.decontaminate import find_items
from weftline.llm.fuzzy_lines import dedup_lines
from weftline.llm.imatch import BETWEEN_TERMS, HASH_CHARS, LOWER, NO_TERMS, UPPER, IMatch, fingerprint_documents, likeness
from weftline.llm.kd_shards import kd_shards
from weftline.llm.merkle import merkle_manifest, verify_manifest
from weftline.llm.mixing import Mix, mix_sources
from weftline.llm.multi_index import search
from weftline.llm.near_dup import near_duplicates

from weftline.llm.pii import pseudonymise
from weftline.llm.quality import fit_quality, score_quality
from weftline.llm.ranked import Ranking, rank_documents
from weftline.llm.token_counts import length_histogram, length_table, token_length

REGISTRY: dict[str, tuple] = {}


def register(sql: str | None = None):
    def add(fn):
        REGISTRY[fn.__name__] = (fn, sql)
        return fn

    return add


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpus_pipeline import run

    return run(spark, sf_dir)


REGISTRY["pipeline"] = (pipeline, None)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


QUALITY_CUT = 0.7


def remainder(column: str, of: int):
    return F.crc32(F.col(column).cast("string")) % of


@register()
def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").where(remainder("doc_id", 4) != 2)
    scored = score_quality(docs, fit_quality(docs, labels), keep=["doc_id"])
    return scored.select(
        "doc_id",
        (remainder("doc_id", 4) == 2).alias("held_out"),
        "score",
        (F.col("score") >= QUALITY_CUT).cast("int").alias("predicted"),
    )


@register()
def op2_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return pseudonymise(docs, key=b"a key for the test tables", keep=["doc_id"])


OP3_SQL = """
WITH sized AS MATERIALIZED (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5(concat_ws('|', coalesce(doc_id::VARCHAR, ''), '7')), 1, 15))::BIGINT AS draw
  FROM documents),
ranked AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight
  FROM sized GROUP BY source),
sorted AS (
  SELECT *, source_size * 3 AS cap, sum(source_size) OVER () AS total,
         coalesce(sum(source_size * 3) OVER (ORDER BY source_size * 3 / weight, source NULLS LAST
           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS caps_before,
         sum(weight) OVER (ORDER BY source_size * 3 / weight DESC, source DESC NULLS FIRST) AS weight_left
  FROM ranked),
level AS (
  SELECT max((total - caps_before)::DOUBLE / weight_left::DOUBLE) AS level FROM sorted),
targets AS (
  SELECT source, source_size,
         CASE WHEN cap < level * weight THEN cap::DOUBLE ELSE level * weight END AS target
  FROM sorted, level),
placed AS (
  SELECT doc_id, size, s.source, source_size, target, draw, whole, target - whole * source_size AS rest,
         coalesce(sum(size) OVER (PARTITION BY s.source ORDER BY draw, size
           ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS upto
  FROM sized s JOIN (
    SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole
    FROM targets) t ON s.source IS NOT DISTINCT FROM t.source),
gaps AS (
  SELECT *, rest - coalesce(max(CASE WHEN upto <= rest THEN upto END) OVER (PARTITION BY source), 0) AS gap
  FROM placed),
filled AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY
           CASE WHEN upto > rest AND abs(size - gap) < gap THEN abs(size - gap) END NULLS LAST, draw, size) AS nth
  FROM gaps)
SELECT doc_id, size, source_size, target,
       (size * (whole + CASE WHEN upto <= rest AND rest > 0
                              OR upto > rest AND abs(size - gap) < gap AND nth = 1 THEN 1 ELSE 0 END))::BIGINT AS taken
FROM filled
"""


@register(OP3_SQL)
def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    mixed = mix_sources(docs, Mix())
    return mixed.select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("repeats")).alias("taken")
    )


@register()
def op4_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


@register()
def op5_context_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score_texts(docs, remainder("doc_id", 10) != 0)
    return scored.select(
        F.col("id").alias("doc_id"),
        (remainder("id", 10) == 0).alias("held_out"),
        "n_tokens",
        "n_known",
        "train_tokens",
        "base_score",
        "score",
    )


@register()
def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("text")
    return length_table(length_histogram(docs, token_length(docs)))


OP7_SQL = """
WITH RECURSIVE words AS MATERIALIZED (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\\x20\\x09-\\x0D]+') AS w
  FROM documents),
shingles AS MATERIALIZED (
  SELECT DISTINCT doc_id, hash(list_aggregate(w[i:i + least(len(w), 4) - 1], 'string_agg', ' ')) AS s
  FROM words, unnest(range(1, greatest(len(w) - 2, 2))) AS t(i) WHERE len(w) > 0),
sizes AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c
  FROM shingles x JOIN shingles y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY ALL),
links AS MATERIALIZED (
  SELECT a, b FROM common JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b
  WHERE 100 * c >= 80 * (p.n + q.n - c)),
reach AS (
  SELECT doc_id, doc_id AS other FROM documents
  UNION
  SELECT r.doc_id, l.b FROM reach r JOIN links l ON l.a = r.other),
least_of AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM documents d LEFT JOIN sizes USING (doc_id) JOIN least_of USING (doc_id)
"""


@register(OP7_SQL)
def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), words=4)


@register()
def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return find_items(docs, table(spark, sf_dir, "benchmark"))


@register()
def op9_fuzzy_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(table(spark, sf_dir, "documents"), keep=["doc_id"])


@register()
def op10_kd_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    out = kd_shards(docs, shards=8, keep=["doc_id"])
    return out.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def crc32_sql(value: str) -> str:
    """Unsigned CRC-32 of a string's UTF-8 bytes in SQL, bit by bit."""
    octets = (
        f"list_transform(range(0, octet_length(encode({value}))), "
        f"lambda i: ('0x' || hex(array_slice(encode({value}), i + 1, i + 1)))::BIGINT)"
    )
    return (
        f"xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, {octets}), lambda c, b: "
        "list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[], "
        "lambda x, z: xor(x >> 1, 3988292384 * (x & 1)))))"
    )


def _encoded_sql(column: str) -> str:
    return f"coalesce(octet_length(encode({column}::VARCHAR)) || ':' || {column}, '-')"


def _leaf_sql(text: str) -> str:
    return "sha256(" + " || ".join(_encoded_sql(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"


def _tree_sql(name: str, leaves: str, key: str) -> str:
    """Nodes of trees per ``key`` over leaves(key, pos, n, d): level, run's neighbours left and right."""
    run = f"PARTITION BY {key}, level, pos // 3 ORDER BY pos"
    return f"""
{name}_nodes AS (
  SELECT {key}, 0::BIGINT AS level, pos, n, d FROM {leaves}
  UNION ALL
  SELECT {key}, level + 1, pos // 3, (n + 2) // 3, sha256(string_agg(d, '' ORDER BY pos))
  FROM {name}_nodes WHERE n > 1 GROUP BY {key}, level, pos // 3, n),
{name} AS MATERIALIZED (
  SELECT *, coalesce(string_agg(d, '') OVER ({run} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS lft,
         coalesce(string_agg(d, '') OVER ({run} ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS rgt
  FROM {name}_nodes)"""


def _walk_sql(name: str, start: str, tree: str, key: str) -> str:
    """Rows of start(doc_id, key, pos, now, proof) walked up to the root of their tree."""
    return f"""
{name} AS (
  SELECT doc_id, {key}, 0::BIGINT AS level, pos, now, proof, false AS done FROM {start}
  UNION ALL
  SELECT w.doc_id, w.{key}, w.level + (t.n > 1)::BIGINT, CASE WHEN t.n > 1 THEN w.pos // 3 ELSE w.pos END,
         CASE WHEN t.n > 1 THEN sha256(lft || w.now || rgt) ELSE w.now END,
         CASE WHEN t.n > 1 THEN w.proof || lft || rgt ELSE w.proof END, t.n = 1
  FROM {name} w JOIN {tree} t ON t.{key} IS NOT DISTINCT FROM w.{key} AND t.level = w.level AND t.pos = w.pos
  WHERE NOT done)"""


OP12_SQL = f"""
WITH RECURSIVE changed AS (
  SELECT *, CASE WHEN {crc32_sql("doc_id::VARCHAR")} % 2 = 0 THEN replace(text, chr(10), '') ELSE text END AS now_text
  FROM documents),
leaves AS MATERIALIZED (
  SELECT doc_id, source, {_leaf_sql("text")} AS d, {_leaf_sql("now_text")} AS now, '' AS proof,
         count(*) OVER (PARTITION BY source) AS n,
         row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS pos
  FROM changed),
{_tree_sql("tree", "leaves", "source")},
{_walk_sql("walk", "leaves", "tree", "source")},
subroots AS MATERIALIZED (
  SELECT 0 AS top, source, d, count(*) OVER () AS n, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS pos
  FROM tree WHERE n = 1),
{_tree_sql("crown", "subroots", "top")},
up AS MATERIALIZED (
  SELECT doc_id, 0 AS top, s.pos, now, proof FROM walk w JOIN subroots s ON s.source IS NOT DISTINCT FROM w.source
  WHERE done),
{_walk_sql("crowned", "up", "crown", "top")}
SELECT l.doc_id, l.d AS leaf, s.d AS subroot, r.d AS root, sha256(c.proof) AS proof_sha256,
       c.now AS folded_root, c.now = r.d AS verified
FROM leaves l JOIN subroots s ON s.source IS NOT DISTINCT FROM l.source
JOIN crowned c ON c.doc_id = l.doc_id AND c.done JOIN crown r ON r.n = 1
"""


@register(OP12_SQL)
def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    tampered = F.when(remainder("doc_id", 2) == 0, F.replace(F.col("text"), F.lit("\n"), F.lit("")))
    manifest = merkle_manifest(docs, F.coalesce(tampered, F.col("text")))
    return verify_manifest(manifest).drop("path", "tampered_leaf")


def _imatch_sql(settings: IMatch) -> str:
    term = BETWEEN_TERMS.replace("[", "[^")
    terms = f"list_distinct(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{term}'))"
    places = " UNION ALL ".join(
        f"SELECT t, {f} AS family, ((c * {settings.multiplier(f)}) & 4294967295) >> {32 - bits} AS p FROM kept"
        for f, bits in enumerate(settings.rate_bits)
    )
    size, families = settings.subsets, len(settings.rate_bits)
    hashes = f"""
  SELECT v.doc_id, v.kind, coalesce(list(coalesce(h, '{NO_TERMS}') ORDER BY family, place), []) AS hashes
  FROM (SELECT * FROM having_terms, range({families}) AS f(family), range({size}) AS s(place)) v
  LEFT JOIN subset_hashes USING (doc_id, kind, family, place) GROUP BY ALL"""
    return f"""
WITH docs AS MATERIALIZED (
  SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n_chars FROM documents),
ring AS (
  SELECT *, coalesce(lead(text) OVER w, first_value(text) OVER w) AS next_text,
         coalesce(lead(doc_id) OVER w, first_value(doc_id) OVER w) AS next_id
  FROM docs WINDOW w AS (ORDER BY doc_id DESC)),
edits AS MATERIALIZED (
  SELECT doc_id, next_id, n_chars, text[:n_chars - n_chars // 3] || next_text[:n_chars // 3] AS edited FROM ring),
versions AS MATERIALIZED (
  SELECT doc_id, 'own' AS kind, text FROM docs UNION ALL SELECT doc_id, 'edited', edited FROM edits),
terms AS MATERIALIZED (SELECT doc_id, kind, unnest({terms}) AS t FROM versions),
codes AS MATERIALIZED (SELECT t, {crc32_sql("t")} AS c FROM (SELECT DISTINCT t FROM terms)),
slots AS (
  SELECT c % {1 << settings.counter_bits} AS slot, count(*) AS df FROM terms JOIN codes USING (t)
  WHERE kind = 'own' GROUP BY 1),
kept AS MATERIALIZED (
  SELECT t, c FROM codes JOIN slots ON c % {1 << settings.counter_bits} = slot, (SELECT count(*) AS n FROM docs)
  WHERE df BETWEEN greatest(1, ceil(n * exp(-{settings.high}))) AND greatest(1, floor(n * exp(-{settings.low})))),
placed AS MATERIALIZED (
  SELECT t, family, p % 8 * {size // 8} + p // 8 AS place FROM ({places}) WHERE p < {size}),
subset_hashes AS MATERIALIZED (
  SELECT doc_id, kind, family, place, md5(string_agg(t, ' ' ORDER BY t))[:{HASH_CHARS}] AS h
  FROM terms JOIN placed USING (t) GROUP BY ALL),
having_terms AS (SELECT DISTINCT doc_id, kind FROM terms JOIN kept USING (t)),
prints AS MATERIALIZED (
  SELECT doc_id, kind, coalesce(hashes, [md5(text)]) AS hashes
  FROM versions LEFT JOIN ({hashes}) USING (doc_id, kind)),
places AS (
  SELECT doc_id, near, place, own[place] AS a, other[place] AS b
  FROM (SELECT e.doc_id, 'edited' AS near, a.hashes AS own, b.hashes AS other
        FROM edits e JOIN prints a ON a.doc_id = e.doc_id AND a.kind = 'own'
        JOIN prints b ON b.doc_id = e.doc_id AND b.kind = 'edited'
        UNION ALL
        SELECT e.doc_id, 'next', a.hashes, b.hashes
        FROM edits e JOIN prints a ON a.doc_id = e.doc_id AND a.kind = 'own'
        JOIN prints b ON b.doc_id = e.next_id AND b.kind = 'own'), range(1, {families * size + 1}) AS p(place)),
told AS (
  SELECT doc_id, near, (place - 1) // {size} AS family, count(*) AS n,
         count(*) FILTER (a IS NOT DISTINCT FROM b) AS same
  FROM places WHERE coalesce(a, '{NO_TERMS}') <> '{NO_TERMS}' OR coalesce(b, '{NO_TERMS}') <> '{NO_TERMS}'
  GROUP BY ALL),
alike AS MATERIALIZED (
  SELECT doc_id, near, coalesce(max(same::DOUBLE / n) FILTER (n >= {settings.enough}), sum(same)::DOUBLE / sum(n)) AS share
  FROM told GROUP BY ALL)
SELECT e.doc_id, n_chars, sha256(e.edited) AS edited_sha256, array_to_string(a.hashes, '') AS fingerprint,
       array_to_string(b.hashes, '') AS edited_fingerprint, x.share AS near_edited, y.share AS near_next
FROM edits e JOIN prints a ON a.doc_id = e.doc_id AND a.kind = 'own'
JOIN prints b ON b.doc_id = e.doc_id AND b.kind = 'edited'
JOIN alike x ON x.doc_id = e.doc_id AND x.near = 'edited' JOIN alike y ON y.doc_id = e.doc_id AND y.near = 'next'
"""


@register(_imatch_sql(IMatch()))
def op13_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fingerprint_documents(table(spark, sf_dir, "documents"), IMatch())
    return out.select(
        "doc_id",
        F.char_length("text").cast("long").alias("n_chars"),
        F.sha2("edited_text", 256).alias("edited_sha256"),
        F.array_join("hashes", "").alias("fingerprint"),
        F.array_join("edited_hashes", "").alias("edited_fingerprint"),
        likeness(F.col("hashes"), F.col("edited_hashes")).alias("near_edited"),
        likeness(F.col("hashes"), F.col("next_hashes")).alias("near_next"),
    )


OP11_SQL = f"""
WITH words AS MATERIALIZED (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'),
         '{BETWEEN_TERMS.replace("[", "[^")}')) AS t FROM documents),
lengths AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM words GROUP BY doc_id),
total AS (SELECT count(*) AS docs, sum(n)::BIGINT AS terms FROM lengths),
asked AS MATERIALIZED (
  SELECT item_id, t, count(*) AS q FROM (
    SELECT item_id, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'),
           '{BETWEEN_TERMS.replace("[", "[^")}')) AS t FROM benchmark) GROUP BY ALL),
held AS MATERIALIZED (
  SELECT doc_id, t, count(*) AS tf FROM words WHERE t IN (SELECT t FROM asked) GROUP BY ALL),
weights AS (
  SELECT t, floor(1000 * ln((2 * any_value(docs) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w
  FROM held, total GROUP BY t),
impacts AS MATERIALIZED (
  SELECT doc_id, t, w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // terms))) AS impact
  FROM held JOIN weights USING (t) JOIN lengths USING (doc_id), total),
scores AS (
  SELECT item_id, doc_id, sum(q * impact)::BIGINT AS score FROM asked JOIN impacts USING (t) GROUP BY ALL)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score
FROM scores WHERE score > 0
QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= 20
"""


@register(OP11_SQL)
def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), Ranking())
