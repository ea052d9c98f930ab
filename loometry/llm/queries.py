"""One query per operator, over the whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
#: DuckDB twins. The other queries give hashes or models that SQL does not have;
#: tests/llm compares those with brute force.
ORACLE: dict[str, str] = {}


def query(build):
    QUERIES[build.__name__] = build
    return build


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


@query
def op3_rendezvous_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loometry.llm.sharding import shard_documents

    return shard_documents(table(spark, sf_dir, "documents"), 40)


@query
def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loometry.llm.decontaminate import contamination

    judged = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return judged.select("doc_id", "_found.*")


@query
def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loometry.llm.toxicity import toxicity

    judged = toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.select("doc_id", "_toxicity.*")


@query
def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loometry.llm.html_text import extract

    pages = extract(table(spark, sf_dir, "pages"))
    return pages.select("page_id", "url", pages["_text"].alias("text"))


@query
def op1_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from loometry.llm.token_store import digests, write
    from loometry.session import shared_dir

    documents = table(spark, sf_dir, "documents")
    path = shared_dir(spark, "tokens")
    write(documents, public_tokenizers.path("byte_bpe_50k.json"), path)
    return digests(documents.select("doc_id"), path).withColumnRenamed("key", "doc_id")


@query
def op4_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    from pyspark.sql import functions as F

    from loometry.llm.pieces import encode

    encoded = encode(table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("piece_bpe_32k.model"))
    return encoded.select("doc_id", F.size("_ids").alias("n_ids"), F.col("_ids").alias("ids"), F.col("_same").alias("round_trip"))


@query
def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from loometry.llm.minhash import near_duplicates

    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept")
    )


@query
def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loometry.llm.substring_dedup import remove_repeats

    kept = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "_kept.n_words", "_kept.n_removed", kept["_kept.sha256"].alias("kept_sha256"))


@query
def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loometry.llm.suffix_dedup import remove_earlier

    kept = remove_earlier(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "_kept.n_bytes", "_kept.n_removed", "_kept.n_spans", kept["_kept.sha256"].alias("kept_sha256"))


@query
def op6_vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loometry.llm.vector_search import top_k, usable, whole_numbers

    rows = table(spark, sf_dir, "embeddings")
    vectors = rows.filter(usable(rows["embedding"])).select("vec_id", whole_numbers(rows["embedding"]).alias("vector"))
    return top_k(vectors, vectors.filter("vec_id % 50 = 0"), 5)


ORACLE["op6_vector_search"] = """
WITH v AS (
    SELECT vec_id, [floor(256 * CAST(x AS DOUBLE)) FOR x IN embedding] AS q FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len([1 FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), s AS (
    SELECT a.vec_id AS query_id, b.vec_id, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
    FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0
), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ALNUM = r"regexp_extract_all({}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_NOT_SPACE = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"

ORACLE["op5_substring_dedup"] = f"""
WITH d AS (SELECT doc_id, {_NOT_SPACE.format("coalesce(text, '')")} AS w FROM documents),
g AS (SELECT doc_id, p, array_to_string(list_slice(w, p, p + 34), ' ') AS s FROM d, unnest(range(1, greatest(len(w) - 33, 1))) t(p)),
r AS (SELECT doc_id, p FROM (SELECT *, count(*) OVER (PARTITION BY s) AS n FROM g) WHERE n > 1),
c AS (SELECT DISTINCT doc_id, q FROM r, unnest(range(p, p + 35)) t(q)),
x AS (SELECT doc_id, q, w[q] AS word FROM d, unnest(range(1, len(w) + 1)) t(q)),
k AS (SELECT x.doc_id, count(c.q) AS n_removed, string_agg(word, ' ' ORDER BY x.q) FILTER (WHERE c.q IS NULL) AS kept
  FROM x LEFT JOIN c ON x.doc_id = c.doc_id AND x.q = c.q GROUP BY x.doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k ON d.doc_id = k.doc_id
"""

ORACLE["op7_decontaminate"] = f"""
WITH d AS (SELECT doc_id, {_ALNUM.format(_LOWER)} AS w FROM documents),
i AS (SELECT item_id, {_ALNUM.format(_LOWER)} AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(list_slice(w, p, p + least(len(w), 13) - 1), ' ') AS s
  FROM i, unnest(range(1, greatest(len(w) - 12, 1) + 1)) t(p) WHERE len(w) > 0),
dn AS (SELECT * FROM d, (SELECT DISTINCT n FROM win) k),
g AS (SELECT doc_id, p, n, array_to_string(list_slice(w, p, p + n - 1), ' ') AS s FROM dn, unnest(range(1, greatest(len(w) - n + 2, 1))) t(p)),
hits AS (SELECT g.doc_id, g.p, g.n, win.item_id FROM g JOIN win ON g.s = win.s AND g.n = win.n),
hw AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT DISTINCT doc_id, p, n FROM hits) h, unnest(range(p, p + n)) t(q) GROUP BY doc_id),
iw AS (SELECT r, p, least(len(w), 13) AS n, array_to_string(list_slice(w, p, p + least(len(w), 13) - 1), ' ') AS s
  FROM (SELECT row_number() OVER () AS r, w FROM i), unnest(range(1, greatest(len(w) - 12, 1) + 1)) t(p) WHERE len(w) > 0),
al AS (SELECT doc_id, r, n, g.p - iw.p AS shift, g.p FROM g JOIN iw USING (s, n)),
run AS (SELECT *, p - row_number() OVER (PARTITION BY doc_id, r, shift ORDER BY p) AS k FROM al),
lo AS (SELECT doc_id, max(c) AS n_longest FROM (SELECT doc_id, count(*) + any_value(n) - 1 AS c FROM run GROUP BY doc_id, r, shift, k) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS listed FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM hits) GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(listed, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated, coalesce(n_longest, 0) AS n_longest
FROM d LEFT JOIN hw ON d.doc_id = hw.doc_id LEFT JOIN it ON d.doc_id = it.doc_id LEFT JOIN lo ON d.doc_id = lo.doc_id
"""

ORACLE["op10_minhash"] = f"""
WITH RECURSIVE d AS (SELECT doc_id, {_NOT_SPACE.format(_LOWER)} AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, p, p + 2), ' ') AS s FROM d, unnest(range(1, greatest(len(w) - 1, 2))) t(p) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
link AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
reach(a, b) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a)
SELECT d.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(reach.b) AS component_id, d.doc_id = min(reach.b) AS kept
FROM d LEFT JOIN n ON d.doc_id = n.doc_id JOIN reach ON d.doc_id = reach.a GROUP BY d.doc_id
"""


@query
def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    from pyspark.sql import functions as F

    from loometry.llm.packing import pack_texts

    packed = pack_texts(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return packed.select(
        F.col("key").alias("doc_id"), "start", "length", F.crc32("ids").alias("ids_crc32"), F.col("n_ids").alias("doc_tokens"), "sequence_id", "offset"
    )


@query
def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loometry.llm.lexical import rank

    return rank(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLE["op11_lexical_search"] = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_ALNUM.format(_LOWER)} AS w FROM documents),
i AS (SELECT DISTINCT item_id, unnest({_ALNUM.format(_LOWER)}) AS term FROM benchmark),
c AS (SELECT count(*) FILTER (len(w) > 0) AS nn, CAST(sum(len(w)) AS BIGINT) AS ll FROM d),
p AS (SELECT r, doc_id, term, n, count(*) AS tf FROM (SELECT r, doc_id, len(w) AS n, unnest(w) AS term FROM d) GROUP BY ALL),
f AS (SELECT term, count(*) AS df FROM p GROUP BY term),
s AS (SELECT item_id, doc_id, r, CAST(sum(CAST(floor(1000 * ln((2 * nn + 2) / (2 * df + 1))) AS BIGINT)
    * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * nn) // ll)))) AS BIGINT) AS score
  FROM i JOIN p USING (term) JOIN f USING (term) CROSS JOIN c GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM k WHERE rank <= 10
"""


@query
def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loometry.llm.conversation_repair import repair_damaged

    return repair_damaged(table(spark, sf_dir, "conversations"))
