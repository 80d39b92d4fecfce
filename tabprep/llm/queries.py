"""The contract queries: each applies its operator to a whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import exact_dedup, licenses, mixing, packing, phrases, quality, secrets, sharding, simhash, spelling, substring_dedup, toxicity, trie

TOKENIZER = "word_bpe_49k.json"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_groups(table(spark, sf_dir, "documents")).drop("text_sha256")


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(table(spark, sf_dir, "documents")).drop("kept")


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_dedup.exact_groups(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.interleave(table(spark, sf_dir, "documents"))
    none = F.lit(None).cast("int")
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", none.alias("grown_shard"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing.mix_plan(table(spark, sf_dir, "documents"))
    return plan.select("doc_id", "size", "source_size", "target", "taken", F.array_join(F.col("shards").cast("array<string>"), ",").alias("shards"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_groups(table(spark, sf_dir, "documents"))


def op12_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.edited_fingerprints(table(spark, sf_dir, "documents"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.conversation_trie(table(spark, sf_dir, "conversations"), lend=True)


#: SQL for the unsigned CRC-32 of a text of code points below 256: the bits of its UTF-8 bytes, lowest first, are divided one by one.
CRC32_SQL = """xor(4294967295, list_reduce(list_prepend(4294967295, flatten(list_transform(
    flatten(list_transform(string_split({0}, ''), lambda c: CASE WHEN ord(c) < 128 THEN [ord(c)] ELSE [192 + (ord(c) >> 6), 128 + (ord(c) & 63)] END)),
    lambda b: list_transform(range(8), lambda k: CAST((b >> CAST(k AS INTEGER)) & 1 AS BIGINT))))),
    lambda c, bit: xor(c >> 1, (xor(c, bit) & 1) * 3988292384)))"""

QUERIES = {
    "op1_secret_scan": op1_secret_scan,
    "op2_quality_rules": op2_quality_rules,
    "op3_best_fit_packing": op3_best_fit_packing,
    "op4_simhash": op4_simhash,
    "op5_substring_dedup": op5_substring_dedup,
    "op6_license_scan": op6_license_scan,
    "op7_exact_dedup": op7_exact_dedup,
    "op8_sharding": op8_sharding,
    "op9_toxicity": op9_toxicity,
    "op10_mixing": op10_mixing,
    "op11_spelling_variants": op11_spelling_variants,
    "op12_document_fingerprints": op12_document_fingerprints,
    "op13_prefix_trie": op13_prefix_trie,
}

ORACLE_SQL = {
    "op5_substring_dedup": r"""
        WITH texts AS (
            SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
        ), windows AS (
            SELECT r, i, array_to_string(words[i : i + 34], ' ') AS body
            FROM (SELECT r, words, unnest(range(1, len(words) - 33)) AS i FROM texts WHERE len(words) >= 35)
        ), repeated AS (
            SELECT r, i FROM windows QUALIFY count(*) OVER (PARTITION BY body) > 1
        ), gone AS (
            SELECT DISTINCT r, unnest(range(i, i + 35)) AS place FROM repeated
        ), words AS (
            SELECT r, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS place FROM texts
        ), kept AS (
            SELECT r, string_agg(word, ' ' ORDER BY place) AS body, count(*) AS n
            FROM words ANTI JOIN gone USING (r, place) GROUP BY r
        )
        SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(len(words) - coalesce(n, 0) AS BIGINT) AS n_removed,
               sha256(coalesce(body, '')) AS kept_sha256
        FROM texts LEFT JOIN kept USING (r)
    """,
    "op7_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
               doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
    """,
    "op11_spelling_variants": f"""
        WITH RECURSIVE runs AS (
            SELECT doc_id, translate(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-zÀ-ÿ]+')),
                                     'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents
        ), hashed AS (
            SELECT run, n, {CRC32_SQL.format("coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run")} AS h
            FROM (SELECT doc_id, run, count(*) AS n FROM runs GROUP BY ALL)
        ), words AS (
            SELECT word, CAST(sum(n) AS BIGINT) AS n
            FROM (SELECT CASE WHEN h % 97 = 0 THEN run[: h % length(run)] || run[h % length(run) + 2 :] ELSE run END AS word, n FROM hashed)
            WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3
        ), cut AS (
            SELECT word, n, place, word[: place - 1] || word[place + 1 :] AS rest
            FROM (SELECT word, n, CAST(unnest(range(1, length(word) + 1)) AS INTEGER) AS place FROM words)
        ), near AS (
            SELECT a.word, b.word AS other, b.n FROM cut a JOIN cut b ON a.place = b.place AND a.rest = b.rest AND a.word <> b.word
            UNION SELECT c.word, w.word, w.n FROM cut c JOIN words w ON c.rest = w.word
            UNION SELECT w.word, c.word, c.n FROM cut c JOIN words w ON c.rest = w.word
        ), best AS (
            SELECT word, count(*) AS n_near, arg_min(other, (-n, other)) AS other, max(n) AS n FROM near GROUP BY word
        ), forms AS (
            SELECT w.word, CASE WHEN b.n >= 2 * w.n THEN b.other END AS form, w.n, coalesce(b.n_near, 0) AS n_near,
                   CASE WHEN b.n >= 2 * w.n THEN b.n END AS form_n
            FROM words w LEFT JOIN best b USING (word)
        ), ways AS (
            SELECT word, word AS root FROM forms
            UNION ALL SELECT ways.word, forms.form FROM ways JOIN forms ON forms.word = ways.root WHERE forms.form IS NOT NULL
        ), ends AS (
            SELECT ways.word, ways.root FROM ways JOIN forms ON forms.word = ways.root WHERE forms.form IS NULL
        )
        SELECT word, form, root, n, n_near, form_n FROM forms JOIN ends USING (word)
    """,
    "op13_prefix_trie": rf"""
        WITH given AS (
            SELECT conv_id, list([coalesce(role, ''), coalesce(text, '')] ORDER BY turn NULLS FIRST) AS turns
            FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
        ), hashed AS (
            SELECT conv_id, turns, conv_id - (conv_id % 20 + 20) % 20 AS base, {CRC32_SQL.format("CAST(conv_id AS VARCHAR)")} % 4 AS h FROM given
        ), rebuilt AS (
            SELECT c.conv_id, coalesce(b.turns[: c.h], []) || c.turns[c.h + 1 :] AS turns
            FROM hashed c LEFT JOIN given b ON b.conv_id = c.base
        ), places AS (
            SELECT conv_id, len(turns) AS length, CAST(unnest(range(0, len(turns) + 1)) AS BIGINT) AS depth, turns FROM rebuilt
        ), keyed AS (
            SELECT conv_id, length, depth, sha256(CAST(to_json(turns[: depth]) AS VARCHAR)) AS node,
                   CASE WHEN depth > 0 THEN sha256(CAST(to_json(turns[: depth - 1]) AS VARCHAR)) END AS parent,
                   CASE WHEN depth > 0 THEN len(regexp_extract_all(turns[depth][2], '[^\x20\x09-\x0D]+')) ELSE 0 END AS words
            FROM places
        ), nodes AS (
            SELECT node, any_value(depth) AS depth, any_value(parent) AS parent, any_value(words) AS words, min(conv_id) AS conv_id, count(*) AS n_convs,
                   sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (length = depth), '')) AS ends_sha256
            FROM keyed GROUP BY node
        ), fanned AS (
            SELECT n.*, (SELECT count(*) FROM nodes c WHERE c.parent = n.node) AS n_children FROM nodes n
        ), above AS (
            SELECT DISTINCT low.node, up.node AS top FROM keyed low JOIN keyed up ON low.conv_id = up.conv_id AND up.depth <= low.depth
        ), trees AS (
            SELECT top, count(*) FILTER (n_children = 0) AS n_leaves, CAST(sum((n_convs - 1) * words) AS BIGINT) AS saved_tokens
            FROM above JOIN fanned USING (node) GROUP BY top
        )
        SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, n.n_children, t.n_leaves, t.saved_tokens, n.ends_sha256
        FROM fanned n JOIN trees t ON t.top = n.node LEFT JOIN nodes p ON p.node = n.parent
    """,
}
