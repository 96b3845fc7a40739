"""The registered queries of this subpackage, one for each operator, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe, chat_format, conversation_repair, embed_dedup, html_extract, lang_id, ngram_lm, packing, phrases, simhash, substring_dedup, toxicity
from .common import read_table
from .repair_sql import REPAIR


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    decoded = bpe.decode(bpe.encode(docs))
    ids = F.array_join(F.col("token_ids").cast("array<string>"), " ")
    return decoded.select("doc_id", F.size("token_ids").cast("long").alias("n_tokens"), F.sha2(ids.cast("binary"), 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op2_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op3_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.near_duplicates(read_table(spark, sf_dir, "embeddings"))


def op4_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(read_table(spark, sf_dir, "pages"))


def op5_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup.remove_repeats(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def remainder(id_col: F.Column, by: int) -> F.Column:
    return F.crc32(id_col.cast("string").cast("binary")) % by


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    model = toxicity.train(docs, read_table(spark, sf_dir, "labels"), lambda i: remainder(i, 3) != 1)
    return toxicity.score(docs, model).select("doc_id", (remainder(F.col("doc_id"), 3) == 1).alias("held_out"), "score", "predicted")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read_table(spark, sf_dir, "documents"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roles are learned from conversations whose crc32 mod 3 is not 1, and hidden from the decoding of all of them."""
    conversations = read_table(spark, sf_dir, "conversations")
    held_out = remainder(F.col("conv_id"), 3) == 1
    model = chat_format.train(conversations, ~held_out)
    return chat_format.format_chats(conversations.drop("role"), model).withColumn("held_out", held_out)


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    held_out = remainder(F.col("doc_id"), 5) == 0
    found = lang_id.identify(docs, lang_id.train(docs, ~held_out))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def damaged(rows: DataFrame) -> DataFrame:
    """The rows of conversations with the faults that op11's contract plants, by the CRC-32 of `conv_id:turn`."""
    rows = rows.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    place = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    kind = F.crc32(place.cast("binary")) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(kind == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.when(kind == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    return rows.filter(kind != 0).select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("copy")).drop("copy")


def op11_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = read_table(spark, sf_dir, "conversations")
    found = conversation_repair.summary(conversation_repair.repair(damaged(conversations)))
    every = conversations.select("conv_id").distinct().withColumn("conv", F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")))
    none = {"audit": F.lit(""), "repaired_sha256": F.sha2(F.lit("").cast("binary"), 256)}
    return every.join(found, "conv", "left").select("conv_id", *[F.coalesce(c, none.get(c, F.lit(0))).alias(c) for c in found.columns if c != "conv"])


def op12_ngram_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    held_out = remainder(F.col("doc_id"), 7) == 2
    model = ngram_lm.train_model(docs, ~held_out)
    return ngram_lm.score(docs, model, ~held_out).withColumn("held_out", held_out)


def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(read_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bpe": op1_bpe,
    "op2_ann": op2_ann,
    "op3_embedding": op3_embedding,
    "op4_html": op4_html,
    "op5_substring": op5_substring,
    "op6_toxicity": op6_toxicity,
    "op7_packing": op7_packing,
    "op8_simhash": op8_simhash,
    "op9_chat": op9_chat,
    "op10_language": op10_language,
    "op11_repair": op11_repair,
    "op12_ngram_lm": op12_ngram_lm,
    "op13_phrases": op13_phrases,
}

#: DuckDB SQL over whole tables.
ORACLE_SQL: dict[str, str] = {
    "op3_embedding": """
        WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        n AS (SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS r FROM v WHERE list_dot_product(e, e) > 0),
        l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM n a JOIN n b ON a.vec_id <> b.vec_id AND list_dot_product(a.e, b.e) / (a.r * b.r) >= 0.9),
        reach AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM reach r JOIN l ON r.b = l.a),
        c AS (SELECT a, count(*) AS n_links FROM l GROUP BY a), m AS (SELECT a, min(b) AS least FROM reach GROUP BY a)
        SELECT e.vec_id, coalesce(n_links, 0) AS n_links, least(e.vec_id, coalesce(m.least, e.vec_id)) AS component_id, e.vec_id <= coalesce(m.least, e.vec_id) AS kept
        FROM embeddings e LEFT JOIN c ON c.a = e.vec_id LEFT JOIN m ON m.a = e.vec_id
    """,
    "op5_substring": r"""
        WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words FROM documents),
        s AS (SELECT doc_id, unnest(generate_series(1, len(words) - 34)) AS i FROM d WHERE len(words) >= 35),
        w AS (SELECT s.doc_id, s.i, md5(array_to_string(d.words[s.i : s.i + 34], ' ')) AS h FROM s JOIN d USING (doc_id)),
        r AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY h) AS k FROM w) WHERE k > 1),
        c AS (SELECT doc_id, list(DISTINCT p) AS gone FROM (SELECT doc_id, unnest(generate_series(i, i + 34)) AS p FROM r) GROUP BY doc_id)
        SELECT d.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed,
               sha256(array_to_string(CASE WHEN gone IS NULL THEN words ELSE list_filter(words, lambda x, k: NOT list_contains(gone, k)) END, ' ')) AS kept_sha256
        FROM d LEFT JOIN c USING (doc_id)
    """,
    "op11_repair": REPAIR,
    "op13_phrases": r"""
        WITH p AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM (
                SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)),
        g AS (SELECT lang, size, unnest(list_transform(range(1, len(w) - size + 2), lambda i: array_to_string(w[i : i + size - 1], ' '))) AS phrase FROM p CROSS JOIN (SELECT unnest([1, 2, 3, 4]) AS size) WHERE len(w) >= size),
        f AS (SELECT lang, size, phrase, count(*) AS a FROM g GROUP BY ALL),
        n AS (SELECT lang, sum(a) AS n FROM f WHERE size = 1 GROUP BY lang),
        c AS (SELECT lang, size, phrase, a, string_split(phrase, ' ') AS w FROM f WHERE size > 1 AND a >= 30),
        k AS (SELECT c.lang, c.size, c.phrase, c.a, k, h.a AS l, t.a AS r, CAST(2000000 AS HUGEINT) * c.a // (h.a + t.a) AS score
              FROM (SELECT *, unnest(range(1, size)) AS k FROM c) c JOIN f h ON h.lang = c.lang AND h.phrase = array_to_string(c.w[1 : c.k], ' ') AND h.size = c.k
              JOIN f t ON t.lang = c.lang AND t.phrase = array_to_string(c.w[c.k + 1 : c.size], ' ') AND t.size = c.size - c.k),
        s AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS nth FROM k) WHERE nth = 1),
        i AS (SELECT lang, phrase, max(a) AS longest FROM (SELECT lang, a, array_to_string(w[b : b + len - 1], ' ') AS phrase
              FROM (SELECT *, unnest(range(1, size - len + 2)) AS b FROM (SELECT *, unnest(range(2, size)) AS len FROM c))) GROUP BY ALL),
        o AS (SELECT s.*, row_number() OVER (PARTITION BY s.lang ORDER BY score DESC, a DESC, s.phrase) AS rank FROM s LEFT JOIN i ON i.lang = s.lang AND i.phrase = s.phrase
              WHERE NOT coalesce(CAST(100 AS HUGEINT) * longest >= CAST(80 AS HUGEINT) * a, FALSE))
        SELECT o.lang, rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score FROM o JOIN n ON n.lang = o.lang WHERE rank <= 2000
    """,
}
